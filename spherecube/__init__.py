"""Region x time x feature data cubes on Spark.

Every operator is a function from DataFrames to a DataFrame. Observations stay distributed; only feature-by-feature
matrices and single summary rows reach the driver.
"""
