"""Relational operators over behaviors, interactions and recommendations."""
