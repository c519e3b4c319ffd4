"""Readers and writers over files."""
