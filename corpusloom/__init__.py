"""corpusloom: corpus preparation and analytics expressed as Spark DataFrames."""
