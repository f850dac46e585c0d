"""Operators for training-data pipelines over a table of documents.

Nothing outside this subpackage imports it, except the entry file and ``corpus_pipeline.py``.
"""
