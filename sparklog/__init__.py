"""Spark-native operators for partitioned, append-only record logs."""
