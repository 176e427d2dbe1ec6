"""A Spark-first engine for versioned change logs, page codecs and corpus work."""
