"""Readers: a path or table name in, a typed DataFrame out."""
