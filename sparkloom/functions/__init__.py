"""Column functions: text, numbers and scores."""
