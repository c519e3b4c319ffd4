"""Incremental form of the resumable scoring job."""
