"""Configuration documents and stored tables."""
