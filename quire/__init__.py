"""quire: layout-aware document processing on Spark DataFrames."""
