"""Operators for preparing training data. Nothing else in the library imports this package.

``queries.QUERIES`` and ``queries.ORACLES`` hold the registered query of each operator and its SQL, where SQL can state it.
"""
