"""Streaming of tallgrass."""
