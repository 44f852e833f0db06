"""Operators for preparing large text collections for training; the rest of the library does not import them."""
