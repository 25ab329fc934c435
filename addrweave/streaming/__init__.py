"""Matching of arriving addresses."""
