"""Operators for corpora of training documents. Nothing else in the library imports this subpackage."""
