"""Scalar functions as Column expressions; Python only where Catalyst has no form of it."""
