"""Whole compress / decompress / evaluate jobs assembled from the operators."""
