"""Readers and writers of graph, window, adjacency and stream files."""
