"""The reference queries by name."""
