"""Analytic operators, DataFrame to DataFrame."""
