"""Spark jobs that audit staged, model-written code reviews."""
