"""Prediction-market analytics as Spark jobs."""
