"""Readers: each returns one typed DataFrame of raw records per format."""
