"""Operators for preparing training text: one module for each, none of them needed by the rest of the library."""
