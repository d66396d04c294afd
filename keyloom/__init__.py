"""Perfect hash functions over DataFrame keys, built and evaluated on Spark."""
