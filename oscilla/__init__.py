"""A PySpark-native analytics engine for condition monitoring and document-grounded workloads."""
