"""Spark-native analytics engine: cohorts, ratings, graphs, text and stories as DataFrame operators."""
