"""Image, vector and tensor analytics as Spark DataFrame plans."""
