"""Plans of tallgrass."""
