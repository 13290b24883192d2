"""quarry plans."""
