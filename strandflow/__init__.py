"""Spark-native lineage analytics: detections and association scores to repaired, scored lineage graphs."""
