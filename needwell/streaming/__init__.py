"""Incremental versions of the ingest job and of run accounting."""
