"""Incremental preparation of arriving files."""
