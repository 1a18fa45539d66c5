"""Text to words, as Column expressions that stay in the JVM.

White space ends a word; letters are kept and lower-cased one by one; hyphens and combining
diacritics are kept after the first letter; all else is dropped. Over-long words and the
end-of-document marker are null words. What remains is NFKD-normalised.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_letters, ascii_lowercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import END_OF_DOCUMENT, LIMITS

SPACE = r"\p{IsWhite_Space}"
_HYPHEN = r"\x{2D}\x{AD}\x{58A}\x{1806}\x{2010}\x{2011}\x{2E17}\x{30FB}\x{FE63}\x{FF0D}\x{FF65}"
#: Diacritic, neither modifier symbol nor alphabetic (Unicode 14).
_DIACRITIC_RANGES = """B7 300-344 346-34E 350-357 35D-362 483-487 591-5A1 5A3-5AF 658 6DF-6E0 6EA-6EC 740-74A 7EB-7F3 818-819
898-89F 8CA-8D2 8EA-8EF 93C 94D 951-954 9BC 9CD A3C A4D ABC ACD AFD-AFF B3C B4D B55 BCD C3C C4D CBC CCD D3B-D3C D4D DCA E47-E4C
E4E EBA EC8-ECC F18-F19 F35 F37 F39 F3E-F3F F82-F84 F86-F87 FC6 1037 1039-103A 135D-135F 1714-1715 17C9-17D3 17DD 1939-193B
1A75-1A7C 1A7F 1AB0-1ABE 1AC1-1ACB 1B34 1B44 1B6B-1B73 1BAA-1BAB 1C37 1CD0-1CE8 1CED 1CF4 1CF7-1CF9 1DC4-1DCF 1DF5-1DFF
2CEF-2CF1 302A-302F 3099-309A A66F A67C-A67D A6F0-A6F1 A8C4 A8E0-A8F1 A92B-A92E A953 A9B3 A9C0 AABF AAC1 AAF6 ABEC-ABED FE20-FE2F
102E0 10AE5-10AE6 10D22-10D27 10F46-10F50 10F82-10F85 11046 11070 110B9-110BA 11133-11134 11173 111C0 111CA-111CC 11235-11236
112E9-112EA 1133C 1134D 11366-1136C 11370-11374 11442 11446 114C2-114C3 115BF-115C0 1163F 116B6-116B7 1172B 11839-1183A
1193D-1193E 11943 119E0 11A34 11A47 11A99 11C3F 11D42 11D44-11D45 11D97 16AF0-16AF4 16B30-16B36 16FF0-16FF1 1CF00-1CF2D
1CF30-1CF46 1D167-1D169 1D16D-1D172 1D17B-1D182 1D185-1D18B 1D1AA-1D1AD 1E130-1E136 1E2AE 1E2EC-1E2EF 1E8D0-1E8D6 1E944-1E946
1E948-1E94A"""
_DIACRITIC = "".join("-".join(rf"\x{{{end}}}" for end in r.split("-")) for r in _DIACRITIC_RANGES.split())
#: Kept inside a word, dropped before it.
LATER = _HYPHEN + _DIACRITIC


def nfkd(word: Column) -> Column:
    """Compatibility decomposition, by the ICU library that Spark itself brings along."""
    return F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), word, F.lit(True))


#: Single characters of a class are one table, ranges and properties a union of predicates, asked one inside the
#: other; asking many costs a microsecond a character, as their type checks write to memory that all cores share. So
#: ASCII is named one by one, and what most characters are is asked first.
_KEPT = ascii_letters + r" \n\t\x0B\f\r\-"
_ASCII_DROPPED = "".join(rf"\x{{{k:X}}}" for k in range(128) if chr(k) not in ascii_letters + " \n\t\x0b\f\r-")
_DROPPED = rf"[{_ASCII_DROPPED}]|(?![{_KEPT}])(?!\p{{IsAlphabetic}})[^{SPACE}{LATER}]"


#: What isn't ASCII or one of these letters. Of them NFKD makes neither white space nor fewer bytes.
_OTHERS = rf"(?![{''.join(rf'\x{{{k:X}}}' for k in (*range(128), *range(0xC0, 0x100)) if k not in (0xD7, 0xF7))}])[^\x{{100}}-\x{{17E}}]"


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _simple(text: Column) -> Column:
    """Whether a text has nothing but ASCII and letters that may be cleaned and decomposed as a whole."""
    return F.when(_ascii(text), True).otherwise(~text.rlike(_OTHERS))


def clean(text: Column) -> Column:
    """``text`` without the characters that no word keeps, in lower case. Sigma and dotted capital I
    are replaced first: lower() would treat them by context."""
    low = lambda kept: F.lower(F.replace(F.replace(kept, F.lit("Σ"), F.lit("σ")), F.lit("İ"), F.lit("i")))
    simple = F.regexp_replace(low(F.regexp_replace(text, rf"[{_ASCII_DROPPED}]", "")), r"-(?<!\S-)-*", "")
    any_ = F.regexp_replace(low(F.regexp_replace(text, _DROPPED, "")), rf"(?![{ascii_lowercase} \n])(?<![^{SPACE}])[{LATER}]+", "")
    return F.when(_simple(text), simple).otherwise(any_)


def limited(word: Column, limit: int) -> Column:
    """NFKD-normalised, or null where it is too long before or after that; ASCII words are as they are."""
    # through an array: a lambda's argument is computed once, a repeated expression each time
    folded = F.get(F.transform(F.array(nfkd(word)), lambda x: F.when(F.octet_length(x) <= limit, x)), F.lit(0))
    return F.when(F.octet_length(word) <= limit, F.when(F.octet_length(word) == F.length(word), word).otherwise(folded))


def _once(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``x``, which is computed once, however often it is named."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _folded(text: Column) -> Column:
    return F.when(_ascii(text), text).when(text.isNotNull(), nfkd(text))


def words(text: Column) -> Column:
    """All words of a text in order; a null element is a null word. Tokens of which nothing is kept
    are left out and don't break a segment."""
    found = lambda x: F.array_remove(F.split(x, f"{SPACE}+"), "")
    short = lambda c: F.transform(found(_folded(c)), lambda w: F.when(F.octet_length(w) <= LIMITS.word, w))
    any_ = lambda c: F.transform(found(c), lambda w: F.when(w != END_OF_DOCUMENT, limited(w, LIMITS.word)))
    return _once(clean(text), lambda c: F.when(_simple(c) & ~c.contains(END_OF_DOCUMENT), short(c)).otherwise(any_(c)))


# -- part-of-speech lines


def _section(token: Column) -> Column:
    """A section of a line: its cleaned text, and whether it is a tag ("<" before any letter)."""
    return F.struct(clean(token).alias("text"), token.rlike(r"^[^\p{IsAlphabetic}<]*<").alias("tag"))


def _pos_word(line: Column, cleaned: Column) -> Column:
    """For a line "word type lemma" and what clean() leaves of it: struct(n, more, i, c, l): how many
    sections, whether something follows the last, and the word, type and lemma, null where lost.

    Sections without kept characters vanish, so what follows moves to the left. A tag, an over-long
    part, or anything after the lemma (even a blank) makes a null word. Fewer than three sections
    make no word, unless the word or the type has already overflowed.
    """
    tagged = F.filter(F.transform(F.split(line, f"[ {SPACE}]+"), _section), lambda s: s["tag"] | (s["text"] != ""))
    plain = F.transform(F.filter(F.split(cleaned, " "), lambda s: s != ""), lambda s: F.struct(s.alias("text"), F.lit(False).alias("tag")))
    return F.struct(F.when(line.contains("<"), tagged).otherwise(plain).alias("s"), F.substring(line, -1, 1).rlike(SPACE).alias("more"))


#: Clean lines of three sections, and of more.
_THREE, _MORE = r"(?md)^ *+([^ \n]++) ++([^ \n]++) ++([^ \n]++) *+$", r"^ *+(?:[^ \n]++ ++){3}[^ \n]"


def pos_text(text: Column) -> Column:
    """The words of a text of part-of-speech lines, like words(). All lines are cleaned together, line ends
    staying where they are, and read by one expression; a text that has something out of the way (a tag, a line
    that ends in a blank or has more than three sections, a long part, other scripts) is looked at line by line."""
    cleaned = F.regexp_replace(clean(text), rf"(?![{ascii_lowercase} \n]){SPACE}", " ")
    ends = text.rlike(rf"\n(?<={SPACE}\n)(?<!\n\n)(?<!^\n)") | (F.substring(text, -1, 1).rlike(SPACE) & ~text.endswith("\n"))
    plain = lambda c: F.when(~text.contains("<") & ~ends & _simple(c), F.split(F.regexp_replace(_folded(c), _THREE, "$2|$3|$1"), "\n"))
    # a line of no more bytes (or two more, if these are bars) has no part that is too long
    least = min(LIMITS.word, LIMITS.classification, LIMITS.lemma)
    odd = lambda x: F.when(x.contains("|"), F.octet_length(x) > least + 2).otherwise((F.octet_length(x) > least) | x.rlike(_MORE))
    either = lambda t, c: F.when(~F.exists(t, odd), F.filter(t, lambda x: x.contains("|"))).otherwise(_each_line(F.split(text, "\n"), F.split(c, "\n")))
    return _once(cleaned, lambda c: _once(plain(c), lambda t: either(t, c)))


def pos_words(lines: Column) -> Column:
    """The same of an array of lines."""
    # a line end inside a line is white space like any other
    return pos_text(F.array_join(F.transform(lines, lambda x: F.translate(F.coalesce(x, F.lit("")), "\n", " ")), "\n"))


def _each_line(lines: Column, cleaned: Column) -> Column:
    """The words of lines, and what clean() leaves of these, one by one; only a line that holds a "<" is looked
    at section by section."""
    # In steps: a lambda computes a repeated expression anew each time, but not its argument.
    part = lambda x, k, limit: F.when(~F.get(x["s"], F.lit(k))["tag"], limited(F.get(x["s"], F.lit(k))["text"], limit))
    parts = lambda x: F.struct(F.size(x["s"]).alias("n"), x["more"].alias("more"), part(x, 0, LIMITS.word).alias("i"), part(x, 1, LIMITS.classification).alias("c"), part(x, 2, LIMITS.lemma).alias("l"))

    def judge(p: Column) -> Column:
        lost = F.when(p["n"] >= 1, p["i"].isNull()).otherwise(F.lit(False)) | F.when(p["n"] >= 2, p["c"].isNull()).otherwise(F.lit(False))
        whole = (p["n"] == 3) & ~p["more"] & ~lost & p["l"].isNotNull()
        token = F.when(whole, F.concat_ws("|", p["c"], p["l"], p["i"]))
        return F.struct(((p["n"] >= 3) | lost).alias("counts"), token.alias("token"))

    found = F.zip_with(lines, cleaned, _pos_word)
    return F.transform(F.filter(F.transform(F.transform(found, parts), judge), lambda x: x["counts"]), lambda x: x["token"])
