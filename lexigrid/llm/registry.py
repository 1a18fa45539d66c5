"""All queries of this package."""

from __future__ import annotations

from . import q_chat, q_ctw, q_idstore, q_jaccard, q_media, q_mixing, q_packing, q_quality, q_topk, q_warc

_MODULES = (q_ctw, q_packing, q_quality, q_warc, q_jaccard, q_chat, q_media, q_idstore, q_mixing, q_topk)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
