"""Composed plans: fixtures on the driver tables, queries and the cluster pipeline."""
