"""Part of the analytics package."""
