"""Text formats, generators."""
