"""Structured Streaming over file events and telemetry."""
