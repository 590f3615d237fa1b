"""The analysis: blocking, clustering, profiles, near misses, reports, calibration, and studies over releases."""
