"""Reading and writing: JSON records, markup, Parquet tables, CSV and graph export."""
