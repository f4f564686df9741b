"""Readers, writers and bundles."""
