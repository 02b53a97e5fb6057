"""Readers, writers and generated sources."""
