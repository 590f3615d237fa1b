"""What an analysis leaves: the index as Parquet tables, and documents for readers."""
