"""Operators of a training-data pipeline over document tables.

Every operator takes DataFrames and returns one. Those that train a model, size
blocks or search iteratively run jobs while they are called and keep intermediate
tables in the shared folder. Nothing outside this subpackage imports it.
"""
