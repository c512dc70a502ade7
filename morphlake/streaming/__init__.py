"""Rewrites that follow a growing log."""
