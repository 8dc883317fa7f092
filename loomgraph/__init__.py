"""Loomgraph: architecture graphs, search and recall reports as Spark DataFrames."""
