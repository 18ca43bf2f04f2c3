"""Trajectory analytics as composable PySpark DataFrame plans."""
