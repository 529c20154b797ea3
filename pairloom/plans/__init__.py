"""Staged builds and the query registry."""
