"""Structured Streaming jobs: feed ingest, bounded de-duplication, sliding trends."""
