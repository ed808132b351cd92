"""Registered queries with their SQL, and the multi-stage compositions."""
