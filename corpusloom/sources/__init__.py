"""Readers of files and documents."""
