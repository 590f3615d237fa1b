"""Where function rows come from: corpora of other kinds, source files, records of other parsers, and stored tables."""
