"""Operators for training data. Nothing else in the library imports this package."""

from loreline.llm import queries

MODULES = (queries,)
