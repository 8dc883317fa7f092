"""Scans and sinks: source trees, Markdown, graphs, indexes, settings."""
