"""New recordings as streams."""
