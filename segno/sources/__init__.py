"""Readers, writers and quality checks."""
