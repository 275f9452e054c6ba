"""sievewright: corpus curation and query processing on PySpark DataFrames."""
