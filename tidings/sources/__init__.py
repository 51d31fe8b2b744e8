"""Readers for article tables, feeds and stored artefacts, and the writers."""
