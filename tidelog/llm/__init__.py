"""Operators for training-data pipelines.

Nothing outside this subpackage imports it, and it can be removed together
with ``corpus_pipeline.py`` without touching the versioned key/value engine.
"""
