"""Column functions over text, dates and vectors."""
