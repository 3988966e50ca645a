"""Query strategies, stored indexes and windows."""
