"""Whole plans: inference, cards and the decision rule."""
