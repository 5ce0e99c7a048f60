"""Training-data operators over tables of documents and vectors.

Nothing else in the library imports this package; ``queries`` holds the thin
``opN_*`` queries that ``__spark_entry__`` registers.
"""
