"""Column functions: rating scale, credit curves, text helpers."""
