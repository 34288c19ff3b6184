"""Signals over streams of items."""
