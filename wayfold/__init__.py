"""Spark-native multimodal journey analytics."""
