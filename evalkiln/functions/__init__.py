"""Scalar functions of the engine."""
