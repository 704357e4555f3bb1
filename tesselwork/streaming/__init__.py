"""Streams into a repository."""
