"""Queries over the test tables; importing the package registers all of them in the catalog."""

from textloom.plans import answers_check, catalog, comparisons, generation, questions

__all__ = ["answers_check", "catalog", "comparisons", "generation", "questions"]
