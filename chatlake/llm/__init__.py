"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; ``queries.py`` wraps them as the
registered ``opN_<name>`` queries.
"""
