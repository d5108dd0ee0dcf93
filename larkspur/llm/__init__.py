"""Operators for preparing training text. Nothing else in larkspur imports this subpackage."""
