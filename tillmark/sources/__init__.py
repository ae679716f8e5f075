"""Feeds in, tables and files out."""
