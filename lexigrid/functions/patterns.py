"""Search and entropy patterns: strings to small plans. Words go through the rules of the tables.

A search pattern is a list of places parted by blanks: a word, ``*`` (any word or edge), ``$`` (an
edge), or for part-of-speech tables ``[type|lemma|word]``, any part of which may be ``*``; there a
bare word stands for ``[*|*|word]``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..config import EDGE, END_OF_DOCUMENT, LIMITS

ANY = "*"


class PatternError(ValueError):
    pass


@dataclass(frozen=True)
class Place:
    """kind: word, words, any, edge or parts; value: the word, the words (any of them), or the three parts with None for any."""

    kind: str
    value: str | tuple[str | None, ...] | None = None
    bare: bool = True


_BLANK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def split(pattern: str) -> list[str]:
    """The places of a pattern, parted by the white space that parts words."""
    return [t for t in _BLANK.split(pattern) if t]


def normalise(spark: SparkSession, words: list[tuple[str, int]]) -> dict[tuple[str, int], str | None]:
    """Words as the tables hold them, by (word, longest in bytes): None where one is too long to be there
    or is the end-of-document marker. The tables' own rules make them, in one row."""
    from . import text as T

    def one(word: str, limit: int) -> Column:
        clean = T.clean(F.lit(word))
        return F.struct((clean != "").alias("any"), F.when(clean != END_OF_DOCUMENT, T.limited(clean, limit)).alias("word"))

    every = list(dict.fromkeys(words))
    found = spark.range(1).select(*[one(*w).alias(f"p{k}") for k, w in enumerate(every)]).first() if every else ()
    for w, r in zip(every, found):
        if not r["any"]:
            raise PatternError(f"nothing of {w[0]!r} can be searched for")
    return {w: r["word"] for w, r in zip(every, found)}


def parse(spark: SparkSession, pattern: str, pos: bool = False) -> list[Place] | None:
    """The places of a search pattern; None if one is too long to occur."""
    tokens = split(pattern)
    if not tokens:
        raise PatternError("an empty pattern")
    raw: list[tuple[str, list[tuple[str, int] | None]]] = []  # kind, and what of it is to be normalised
    for token in tokens:
        if token in (EDGE, ANY):
            raw.append(("edge" if token == EDGE else "any", []))
        elif token[0] in "*$":
            raise PatternError(f"{token[0]!r} can't begin a longer word: {token!r}")
        elif pos and token[0] == "[":
            inner = token[1:-1].split("|")
            if token[-1] != "]" or len(inner) != 3 or not all(inner):
                raise PatternError(f"{token!r} isn't [type|lemma|word]")
            if any(part != ANY and part[0] == ANY for part in inner):
                raise PatternError(f"'*' can't begin a longer part: {token!r}")
            raw.append(("parts", [None if part == ANY else (part, limit) for part, limit in zip(inner, (LIMITS.classification, LIMITS.lemma, LIMITS.word))]))
        elif any(c in token for c in "[]|") and pos:
            raise PatternError(f"misplaced bracket or bar in {token!r}")
        else:
            raw.append(("parts", [None, None, (token, LIMITS.word)]) if pos else ("word", [(token, LIMITS.word)]))
    if not any(w for _, words in raw for w in words):
        raise PatternError("a pattern needs at least one word")
    known = normalise(spark, [w for _, words in raw for w in words if w])
    if None in known.values():
        return None
    places = []
    for (kind, words), token in zip(raw, tokens):
        got = tuple(w and known[w] for w in words)
        places.append(Place(kind, got[0] if kind == "word" else got or None, bare=token[0] != "["))
    return places


def parse_entropy(pattern: str) -> tuple[int, list[int]]:
    """n and the known positions of an entropy pattern such as "= *"."""
    places = split(pattern)
    if not places or set(places) - {"=", ANY}:
        raise PatternError(f"{pattern!r} isn't made of '=' and '*'")
    known = [k for k, p in enumerate(places) if p == "="]
    if not known or len(known) == len(places):
        raise PatternError("an entropy pattern needs both '=' and '*'")
    return len(places), known
