"""Relational operators over manifests, results and verdicts."""
