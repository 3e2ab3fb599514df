"""Media preparation on Spark: sizing plans, pixel-table rasters, frame sequences, workflow graphs."""
