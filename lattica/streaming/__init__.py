"""Ingest queue and change log."""
