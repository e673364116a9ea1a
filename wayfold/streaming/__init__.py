"""Streams of points and segments."""
