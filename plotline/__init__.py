"""plotline: property-sale analytics written as Spark DataFrame jobs."""
