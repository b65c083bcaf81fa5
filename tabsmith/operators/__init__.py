"""Operators: profiling (E), transform steps (T), splits (C), preprocessing (P), models (M),
metrics (D), run comparison (X), advice (R)."""
