"""functions of lumentab."""
