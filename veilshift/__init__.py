"""Masked, referentially consistent table movement on Spark."""
