"""Readers and writers of locations, addresses, decisions and results."""
