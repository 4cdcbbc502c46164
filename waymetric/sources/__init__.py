"""Readers and writers of the input and result tables."""
