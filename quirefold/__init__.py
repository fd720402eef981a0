"""Document-structure analytics on Spark: layout, lines, neighbours, tables and their algebra as DataFrames."""
