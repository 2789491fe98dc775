"""Operators for preparing training text at scale. Nothing else in the library imports this subpackage.

Each module has one operator; ``queries`` applies them to the given tables, ``oracle`` states results in SQL.
"""
