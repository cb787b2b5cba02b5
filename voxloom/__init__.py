"""Spark-native preparation and measurement of text-labelled speech corpora."""
