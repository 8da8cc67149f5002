"""End-to-end queries over the standard tables."""
