"""Evaluation of factors: information coefficients, shape, portfolios, gates, correlation, combination and control."""
