"""Spatial cell analytics on Spark: neighbour graphs, layer curves, aggregates, interactions and niches of tissue samples."""
