"""Reading and writing tables, JSON side files and fitted state."""
