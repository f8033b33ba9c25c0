"""Readers and writers: nested JSON feeds, CSV catalogues, HTML lists, Parquet bundles, run logs."""
