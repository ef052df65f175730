"""Operators of a training-data pipeline (language ID, de-duplication, mixing, packing, ...).

Nothing else in the package imports this subpackage; its queries and their SQL
twins are listed in ``catalog.py``.
"""
