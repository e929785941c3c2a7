"""Readers and writers: raw typed arrays, step files, tables."""
