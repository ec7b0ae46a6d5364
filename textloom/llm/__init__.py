"""Operators for preparing training text; nothing else in textloom imports this subpackage."""
