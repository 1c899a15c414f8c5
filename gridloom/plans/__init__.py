"""Relations over the star schema and event tables, and the registered queries with their SQL."""
