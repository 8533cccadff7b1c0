"""Scalar functions: text, numbers, JSON in free text, and images."""
