"""Source-code knowledge graphs and corpus preparation as plain PySpark jobs."""
