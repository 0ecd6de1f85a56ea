"""Spark-native analytics for keyed signal streams and their transcripts."""
