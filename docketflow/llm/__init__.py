"""Operators of a training-data pipeline over ``documents`` and ``embeddings``.

Each module holds one operator with its own general interface and the thin
``opN_<name>`` query that derives digest columns from it.  Nothing outside
this folder imports it; ``__spark_entry__`` adds its queries when it is there.
"""
