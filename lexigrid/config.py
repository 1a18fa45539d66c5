"""Sizes and markers of the n-gram model."""

from __future__ import annotations

from dataclasses import dataclass

#: Stands for "no word here": the edge of a segment. No word can contain it.
EDGE = "$"
#: What the written end-of-document marker becomes after cleaning; it breaks segments.
END_OF_DOCUMENT = "endofdocument---"


@dataclass(frozen=True)
class Limits:
    """Longest parts in UTF-8 bytes; anything longer is a null word, which breaks its segment."""

    word: int = 40
    classification: int = 40
    lemma: int = 40


LIMITS = Limits()
