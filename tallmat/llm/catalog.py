"""All queries of this package and their SQL; importing the operator modules registers them."""

from tallmat.llm import alignment, clustering, decontaminate, language_model, near_dedup, ngram_join, packing, pii, quality_rules, ranking, substring_dedup, token_store, toxicity  # noqa: F401
from tallmat.llm.common import ORACLES, QUERIES  # noqa: F401
