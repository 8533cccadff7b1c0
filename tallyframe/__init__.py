"""Spark-first toolkit for evaluating model outputs against human judgement."""
