"""streaming of lumentab."""
