"""tarnwood: retrieval, mining, ingestion, change capture and corpus operators on Spark DataFrames."""
