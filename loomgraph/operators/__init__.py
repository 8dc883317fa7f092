"""Operators over site tables, graphs and indexes."""
