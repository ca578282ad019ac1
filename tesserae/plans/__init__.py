"""Descriptors, selections and what they plan."""
