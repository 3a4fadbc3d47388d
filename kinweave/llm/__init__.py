"""Operators for preparing training text: scoring, deduplication, archives, sharding, tokens.

Nothing outside this folder imports it, apart from the guarded registration in
``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
