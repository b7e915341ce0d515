"""Spark-native analytics over sampled signals, media containers and timed cues."""
