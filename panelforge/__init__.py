"""Point-in-time factor research and training-data preparation as Spark jobs."""
