"""Column-level helpers. Everything here is a plain Spark expression; there is no Python UDF."""
