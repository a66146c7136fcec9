"""tidewell: Spark-native analytics over evidence-based event histories."""
