"""Operators of tallgrass."""
