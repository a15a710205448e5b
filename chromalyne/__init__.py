"""chromalyne: integer-centroid clustering and colour quantisation on Spark DataFrames."""
