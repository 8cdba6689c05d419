"""Operators on digested searches: ranking of query shapes and its report."""
