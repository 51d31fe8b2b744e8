"""Whole plans: the corpus build, the query facade, and the registered queries."""
