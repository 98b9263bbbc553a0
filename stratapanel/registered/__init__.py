"""Registered queries: each module has ``QUERIES``, name -> (function of session and folder, SQL or None)."""
