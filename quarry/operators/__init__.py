"""quarry operators."""
