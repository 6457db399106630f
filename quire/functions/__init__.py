"""Column functions on names, edit operations and sizes."""
