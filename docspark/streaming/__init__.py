"""Converters over streams."""
