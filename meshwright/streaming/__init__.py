"""Streams: link telemetry in event time."""
