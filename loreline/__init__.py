"""Loreline: analytics over serial, link-annotated text on Spark."""
