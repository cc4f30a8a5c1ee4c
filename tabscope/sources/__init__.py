"""Where tables and catalogs come from, and where reports go."""
