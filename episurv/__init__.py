"""Epidemiological-surveillance analytics as plain PySpark DataFrame functions."""
