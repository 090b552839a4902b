"""Spark-native retrieval and change analysis over geo-object archives."""
