"""Change feeds as structured streams."""
