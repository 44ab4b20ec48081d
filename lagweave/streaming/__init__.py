"""Streams of gene profiles."""
