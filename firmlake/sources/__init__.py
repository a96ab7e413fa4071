"""Readers and writers of binary formats, as table functions at the edge."""
