"""Readers and writers, and adapters from the given tables to the engine's schemas."""
