"""Change feeds applied as they arrive."""
