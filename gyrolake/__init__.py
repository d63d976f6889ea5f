"""Spark-native analytics for rotation trajectories and their evaluation reports."""
