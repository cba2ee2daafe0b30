"""Streams of readings."""
