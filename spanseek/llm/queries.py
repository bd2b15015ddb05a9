"""All queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from spanseek.llm import ann, bpe, conversations, decontaminate, html_text, jaccard_join, license_scan, lm_scores, mixing, pii, secrets, toxicity, variants  # noqa: F401
from spanseek.llm.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
