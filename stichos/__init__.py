"""Verse-corpus analytics as Spark DataFrame jobs."""
