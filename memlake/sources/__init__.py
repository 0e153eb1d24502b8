"""Readers that bring outside material into the engine's tables."""
