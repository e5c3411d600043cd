"""Operators that a training-data pipeline needs. Nothing outside this subpackage imports it."""
