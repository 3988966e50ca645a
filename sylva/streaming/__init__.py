"""Appends, sliding windows and the fully dynamic forest."""
