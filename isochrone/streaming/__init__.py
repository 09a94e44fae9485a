"""Operators over streams: bars, ingestion and alerts, on event time."""
