"""Incremental forms of the two intermediates."""
