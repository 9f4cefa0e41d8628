"""Operators for large training-data pipelines over document tables.

Nothing else in the library imports this package; ``llm.queries`` registers
one ``opN_<name>`` query per operator.
"""
