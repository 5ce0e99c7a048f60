"""File catalogs and full-text search over them, as Spark DataFrames."""
