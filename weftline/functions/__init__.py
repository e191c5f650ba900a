"""Column functions built from Spark expressions, with Arrow helpers where bytes matter."""
