"""Named queries over the sample tables."""
