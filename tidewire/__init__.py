"""Spark-first analytics over streams of news posts."""
