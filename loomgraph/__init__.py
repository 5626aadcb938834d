"""Loomgraph: a Spark-native engine for knowledge-graph analytics."""
