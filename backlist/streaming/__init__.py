"""Continuous ingestion of catalog uploads (Structured Streaming)."""

from backlist.streaming.uploads import ingest_uploads

__all__ = ["ingest_uploads"]
