"""All queries of the subpackage."""

from sightline.llm.registry import LLM_QUERIES
from sightline.llm import alignment_queries, chat_queries, classifier_queries, decontaminate_queries, filter_audit_queries, language_queries, license_queries, near_queries, packing_queries, personal_queries, rules_queries, substring_queries, url_queries  # noqa: F401

__all__ = ["LLM_QUERIES"]
