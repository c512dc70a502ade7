"""Operators on key logs and entries, and the batched rewrite."""
