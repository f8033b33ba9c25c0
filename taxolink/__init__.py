"""taxolink: link text records to a hierarchy of classes with Spark DataFrames.

Sub-packages:
  functions  column-level helpers (strings, arrays, time, hashing keys, math)
  sources    readers and writers (nested JSON feeds, CSV catalogues, HTML lists, bundles)
  operators  table-level operators (labels, taxonomy, splits, links, text, scoring, metrics)
  plans      stand-in tables and the driver queries built from the operators
  streaming  incremental ingest of feed files with Structured Streaming
"""

from taxolink.session import get_session, scratch_path

__all__ = ["get_session", "scratch_path"]
