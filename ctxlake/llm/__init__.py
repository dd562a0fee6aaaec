"""Operators for preparing language-model training data, each on a Spark plan of its own."""
