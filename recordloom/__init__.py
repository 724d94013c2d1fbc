"""Spark-native engine for curating, matching and de-duplicating messy catalogue records."""
