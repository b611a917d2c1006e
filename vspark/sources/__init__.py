"""Readers and writers at the edges; between them there are only DataFrames."""
