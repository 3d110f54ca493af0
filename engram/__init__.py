"""Organizational-memory analytics and training-data operators as Spark DataFrame programs."""
