"""Structured Streaming: event intake, outbox upkeep, idempotent application."""
