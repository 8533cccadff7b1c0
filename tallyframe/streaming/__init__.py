"""Streams of results: durable as they come, resumable."""
