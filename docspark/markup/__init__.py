"""Parsers and renderers for Markdown, wiki storage XHTML and Jira wiki markup, over one tree of nodes."""
