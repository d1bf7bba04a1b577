"""Functions of tallgrass."""
