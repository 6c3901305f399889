"""plans of lumentab."""
