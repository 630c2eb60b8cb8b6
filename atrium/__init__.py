"""Floor plans at collection scale on Spark."""
