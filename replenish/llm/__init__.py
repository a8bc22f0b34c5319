"""Operators for preparing training text at corpus scale.

Nothing else in the library imports this package. Each module holds one
operator with its own interface; ``queries`` derives the registered query of
each operator from it.
"""
