"""Operators for large-scale training-data preparation.

One module per operator; each docstring states the method, the guarantees and
what happens to nulls, empty texts, repeated rows and empty tables. Nothing
outside this package imports it (``__spark_entry__`` adds its queries only when
it is present).
"""
