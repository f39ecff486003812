"""Spark jobs that audit promotional content and prepare training data."""
