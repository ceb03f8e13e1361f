"""All queries of this subpackage (importing a module registers its query)."""

from premiumscope.llm import (  # noqa: F401
    q_embeddings,
    q_filters,
    q_language_id,
    q_lexical,
    q_licences,
    q_ngram_join,
    q_pii,
    q_pipeline,
    q_segments,
    q_sentencepieces,
    q_substrings,
    q_tokens,
)
from premiumscope.llm.registry import REGISTRY

__all__ = ["REGISTRY"]
