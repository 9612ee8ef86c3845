"""Point-in-time match analytics expressed as Spark DataFrame functions."""
