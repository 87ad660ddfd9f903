"""plans of the text-measurement engine."""
