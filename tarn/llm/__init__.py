"""Operators of a large-scale training-data pipeline; nothing else in tarn imports this package."""
