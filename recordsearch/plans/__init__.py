"""Whole searches composed of the operators."""
