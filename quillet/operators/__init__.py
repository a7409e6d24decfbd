"""Tokenising, row access and the strict reference reader."""
