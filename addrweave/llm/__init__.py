"""Corpus preparation for language-model training data, as Spark jobs."""
