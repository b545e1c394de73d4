"""Scans and sinks: spec files, file catalogs, statistics CSVs, parquet
tables, and the fail-if-exists writer."""
