"""Reading pages from files and from a wiki's REST interface."""
