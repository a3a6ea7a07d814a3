"""Rule programs that are used often."""
