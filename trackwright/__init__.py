"""Spark-native analytics for object-tracking data of racket sports."""
