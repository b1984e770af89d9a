"""Training-data operators: text, near-duplicate, tokenisation, scoring and formatting jobs.

Nothing outside this package imports it except ``__spark_entry__`` (guarded) and ``corpus_pipeline``.
"""
