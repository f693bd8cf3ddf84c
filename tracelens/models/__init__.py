"""Models of the engine, over pyspark.ml."""
