"""Spark-native analytics for language-model corpora, token shards, run logs and preference data."""
