"""sources of lumentab."""
