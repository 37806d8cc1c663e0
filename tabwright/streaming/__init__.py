"""Incremental and streaming work, run history."""
