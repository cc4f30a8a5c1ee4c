"""Report datasets joined from profiles, keys and catalog analysis."""
