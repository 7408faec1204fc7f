"""A property-graph, retrieval and near-duplicate analytics engine on Spark DataFrames."""
