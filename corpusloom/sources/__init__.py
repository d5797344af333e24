"""Readers, writers and lexicons."""
