"""Graph, matrix, clustering and flow operators on DataFrames."""
