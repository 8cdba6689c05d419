"""Readers: request bodies, slow logs, captured HTTP exchanges, log records."""
