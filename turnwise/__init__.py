"""Conversational-memory analytics as PySpark DataFrame jobs."""
