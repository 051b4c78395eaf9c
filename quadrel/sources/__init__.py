"""Readers of staged files. Nothing here opens a network connection."""
