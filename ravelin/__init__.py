"""Spark-native building, running and analysing of reasoning-benchmark experiments."""
