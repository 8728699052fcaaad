"""Operators for preparing training text: ten of them, and their queries in queries.py."""
