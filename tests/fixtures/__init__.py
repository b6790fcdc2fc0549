"""Operators on hand-made rows with hand-made results: what an operator does at its edges."""
