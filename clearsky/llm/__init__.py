"""Operators for preparing training text at corpus scale.

Each module holds one operator with its own interface; ``queries`` registers
the thin queries over the driver's tables.
"""
