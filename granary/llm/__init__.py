"""Operators of a training-data pipeline: ten numbered operators on documents.

Nothing else in the library imports this subpackage; see ``queries.py`` for the
queries that apply the operators to whole tables.
"""
