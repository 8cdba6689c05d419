"""Slow logs as streams."""
