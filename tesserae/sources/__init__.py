"""Stores, nodes and scans of arrays."""
