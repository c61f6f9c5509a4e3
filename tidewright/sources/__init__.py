"""Bars and auxiliary series."""
