"""Registered queries: the operators bound to the benchmark tables."""
