"""sources of the text-measurement engine."""
