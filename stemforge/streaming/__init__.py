"""Incremental forms: change stream, keyed expiry."""
