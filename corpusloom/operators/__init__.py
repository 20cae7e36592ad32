"""Relational operators over chunks, lines and vectors."""
