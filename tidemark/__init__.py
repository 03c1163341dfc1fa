"""tidemark: a PySpark-native analytics library for operational time series."""
