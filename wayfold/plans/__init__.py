"""Composite search plans."""
