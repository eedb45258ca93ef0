"""Training-data operators: each module holds one operator with a general interface.

``queries`` registers the thin ``opN_<name>`` queries and their SQL.  Nothing
outside this folder imports it except ``__spark_entry__`` (guarded) and
``corpus_pipeline``.
"""
