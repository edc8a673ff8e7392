"""Code-knowledge analytics on Spark: operators as DataFrame plans over typed tables."""
