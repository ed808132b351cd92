"""Incremental maintenance of claim tables."""
