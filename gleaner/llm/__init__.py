"""Training-data operators: quality, deduplication, tokens, language models.

Nothing outside this subpackage imports it; ``corpus_pipeline.py`` and the
guarded block in ``__spark_entry__.py`` are its only users.
"""
