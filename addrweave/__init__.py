"""Cleaning, parsing and linking of postal addresses as Spark jobs."""
