"""Relational operators over the personnel relations."""
