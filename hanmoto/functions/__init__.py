"""Part of the notation engine."""
