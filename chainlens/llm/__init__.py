"""Operators of a training-data pipeline over document and vector tables.

Every operator is a function over DataFrames with its own parameters; the
registered ``opN_<name>`` queries in :mod:`chainlens.llm.registry` apply them
to the driver's tables.  Nothing else in the library imports this package.
"""
