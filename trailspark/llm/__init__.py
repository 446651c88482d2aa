"""Training-data operators: each module holds one operator with its own interface.

Nothing else in the package imports this subpackage.  ``queries.py`` binds the
operators to the driver's tables.
"""
