"""Analytics and retrieval over document libraries, as Spark DataFrame transformations."""
