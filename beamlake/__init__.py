"""Spark-native analytics for georeferenced 3D sensor data."""
