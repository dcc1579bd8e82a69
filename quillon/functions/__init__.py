"""Quillon subpackage."""
