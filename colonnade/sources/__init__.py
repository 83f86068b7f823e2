"""CSV and Parquet."""
