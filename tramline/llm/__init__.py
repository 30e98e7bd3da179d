"""Operators for training-data pipelines: extraction, deduplication, tokenizing, sharding, filtering.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
