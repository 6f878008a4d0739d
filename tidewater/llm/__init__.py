"""Operators for preparing training text: ten corpus operations and their queries."""
