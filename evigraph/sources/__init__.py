"""Snapshot readers with explicit schemas, sinks, and adapters from the star-schema tables."""
