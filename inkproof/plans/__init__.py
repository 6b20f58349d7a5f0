"""Whole flows made of operators."""
