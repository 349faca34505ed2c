"""Readers of feeds and registers."""
