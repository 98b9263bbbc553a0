"""Panels from raw tables, panel files, and the tables beside them."""
