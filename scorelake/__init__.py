"""scorelake: detection-score analytics and training-data preparation on Spark DataFrames."""
