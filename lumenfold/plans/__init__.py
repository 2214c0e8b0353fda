"""Composed plans: rebuild, warehouse layout, export."""
