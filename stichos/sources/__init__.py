"""Readers, writers and corpus shaping."""
