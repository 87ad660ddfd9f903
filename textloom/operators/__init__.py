"""operators of the text-measurement engine."""
