"""Catalogue operators as DataFrame plans."""
