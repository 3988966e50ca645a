"""Spanning forests, expiry staircases and covers as DataFrame operators."""
