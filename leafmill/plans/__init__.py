"""Helpers that shape physical plans: where lineage is cut, how narrow inputs are spread, how far a side may be broadcast."""
