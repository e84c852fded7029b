"""Whole jobs: the given tables as news data, experiments, and the registered queries."""
