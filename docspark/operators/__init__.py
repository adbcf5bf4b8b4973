"""Relational operators on pages, nodes and attachments."""
