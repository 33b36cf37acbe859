"""Point-in-time analytics and training-data preparation on Spark."""
