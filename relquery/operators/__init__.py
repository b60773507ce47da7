"""Results, and writes over copy-on-write tables."""
