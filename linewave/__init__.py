"""linewave: images and signals as relations, analysed with PySpark DataFrames."""
