"""Readers from recordings, logs and trajectory files to tables."""
