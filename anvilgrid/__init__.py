"""anvilgrid: hybrid retrieval, evaluation analytics and corpus preparation on Spark DataFrames."""
