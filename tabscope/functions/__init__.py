"""Rule data and column expressions."""
