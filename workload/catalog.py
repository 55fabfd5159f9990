"""Imports every module that registers queries."""

from workload import companies, ingest, leads, runs, search, streams, text

__all__ = ["companies", "ingest", "leads", "runs", "search", "streams", "text"]
