"""Operators of a training-data pipeline, one module per operator.

Nothing outside this subpackage imports it.  ``QUERIES`` and ``ORACLES`` are
filled by the operator modules and added to the driver contract by
``__spark_entry__``.
"""

from inventa.llm import (  # noqa: F401
    bpe, chat, decontaminate, fim, fingerprint, jaccard, langid, negatives, pii, quality, secrets, substrings, toxicity)
from inventa.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
