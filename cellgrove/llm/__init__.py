"""Operators of a training-data pipeline: one module each, Spark DataFrames in and out.

Nothing outside this folder imports it; ``queries.py`` registers its queries.
"""
