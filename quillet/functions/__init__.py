"""Text to value and value to text, as Columns."""
