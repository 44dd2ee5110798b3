"""Operators of a training-data pipeline over web-scale document tables.

Each module holds one operator with its own general interface; ``queries``
binds them to the driver tables and derives the digest columns. Nothing else
in the library imports this package.
"""
