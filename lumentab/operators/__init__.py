"""operators of lumentab."""
