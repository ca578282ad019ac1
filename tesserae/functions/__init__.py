"""Scalar types, index arithmetic, strict JSON and codecs."""
