"""Operators for preparing language-model training data, one module each.

Nothing outside this subpackage imports it, except ``__spark_entry__.py`` (guarded)
and ``corpus_pipeline.py``.
"""
