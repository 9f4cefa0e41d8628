"""Registered queries, grouped by SURVEY §2 section.

Each section lives in its own module; importing them fills the registry.
"""

from . import (q_evaluate, q_features, q_ml, q_portfolio, q_quality, q_requests,  # noqa: F401
               q_predicates, q_scoring, q_sources, q_streaming, q_layout)
