"""gridloom: lazy PySpark operators for gridded space-time panels and event tables."""
