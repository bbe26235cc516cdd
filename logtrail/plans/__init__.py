"""Whole analyses composed of operators, and the text models."""
