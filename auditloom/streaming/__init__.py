"""Row-local operators on streaming DataFrames."""
