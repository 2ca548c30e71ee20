"""DataFrame operators of the benchmark."""
