"""Workload questions over the digest log."""
