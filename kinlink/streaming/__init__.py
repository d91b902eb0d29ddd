"""Streams of query records against a fixed index."""
