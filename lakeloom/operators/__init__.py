"""Operators that Spark has no word for, composed of its own."""
