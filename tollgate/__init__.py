"""Pricing of risk decisions on Spark: keys, features, costs, experiments."""
