"""Spark-native auditing, profiling and evaluation of page and URL collections."""
