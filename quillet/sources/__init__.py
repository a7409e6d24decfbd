"""Where delimited text comes from and goes to."""
