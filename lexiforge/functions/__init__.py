"""Column functions over words."""
