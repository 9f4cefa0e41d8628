"""Registers the document queries; imported by ``__spark_entry__`` if present."""

from . import q_ann, q_language, q_merkle, q_mixing, q_negatives, q_packing, q_pii, q_quality_rules, q_secrets, q_simhash, q_token_files, q_tokens, q_toxicity  # noqa: F401
