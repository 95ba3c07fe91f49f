"""Features of recordings that are still being written."""
