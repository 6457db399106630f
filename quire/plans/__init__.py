"""Plans of what is to be rendered."""
