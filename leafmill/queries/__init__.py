"""The query catalogue: each module has ``QUERIES`` and their ``SQL``."""
