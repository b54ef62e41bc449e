"""Where rows come from: catalogs of tables, and schemas read from other definitions."""
