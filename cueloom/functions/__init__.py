"""Part of cueloom."""
