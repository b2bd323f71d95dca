"""Scans of tables, and the panel views over them."""
