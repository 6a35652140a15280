"""Compositions of operators: features, training data, scoring, monitoring cycle."""
