"""Incremental ingest and backlog processing."""
