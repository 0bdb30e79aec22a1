"""Readers and writers of text files, JSON arrays, run folders and tables."""
