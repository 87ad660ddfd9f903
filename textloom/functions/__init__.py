"""functions of the text-measurement engine."""
