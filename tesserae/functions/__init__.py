"""Subpackage of tesserae."""
