"""Signal, experiment and corpus analytics as PySpark DataFrames."""
