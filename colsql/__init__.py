"""colsql: a strict SQL dialect, keyed versioned tables and full-text search on Spark."""
