"""Readers and writers of package containers, documents and archives."""
