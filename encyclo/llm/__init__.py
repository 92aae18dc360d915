"""Operators of a training-data pipeline, one module per operator.

Nothing else in the library imports this subpackage.  ``queries`` holds the
registered queries and their SQL; every operator module has its own general
interface (DataFrame in, DataFrame out).
"""
