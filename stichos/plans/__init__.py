"""Whole pipelines, from lines to results."""
