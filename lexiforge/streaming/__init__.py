"""Keystroke streams."""
