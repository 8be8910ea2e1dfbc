"""Operators for preparing training text at scale. Nothing else in kinweave imports this subpackage."""
