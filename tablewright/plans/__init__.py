"""Whole flows built from the operators: cleaning, charts, insights, prediction."""
