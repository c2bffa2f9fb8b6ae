"""Spark-native analytics for sequencing reads, variants, intervals and their truth sets."""
