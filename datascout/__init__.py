"""Dataset discovery, profiling and preparation as Spark DataFrame operators."""
