"""Shapes, key spaces, plans, their differences, and the transforms compiled from them."""
