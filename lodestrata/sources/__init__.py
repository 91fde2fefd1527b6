"""Readers and writers that turn files into text-typed tables and back."""
