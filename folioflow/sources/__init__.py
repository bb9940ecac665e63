"""Readers and writers of the file shapes."""
