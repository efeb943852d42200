"""Intentionally empty: no probing operator keeps state, watermarks or windows over a stream."""
