"""Query catalog: every operator as a named query over the driver tables,
with its DuckDB oracle SQL where one exists."""
