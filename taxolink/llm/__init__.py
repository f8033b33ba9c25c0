"""Operators of a training-data pipeline: chat formatting, source mixing, quality resampling,
vector search and near-dedup, packing, token files, set-similarity join, sharding, HTML extraction.

Nothing else in the library imports this subpackage. Each module is one operator with a general
interface; :mod:`taxolink.llm.queries` holds the thin driver queries.
"""
