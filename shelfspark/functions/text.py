"""Sentence splitting, HTML stripping and title tests as Column expressions."""

from __future__ import annotations

import functools
import html
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.config import TITLE_CATEGORY

# Boundary patterns. Each match gets a newline between its two groups.
FIRST_BOUNDARIES = (
    r"([;；.!?。！？\?])([^”’])",
    r"(\.{6})([^\"’”」』])",
    r"(…{2})([^\"’”」』])",
    r"([;；!?。！？\?][\"’”」』]{0,2})([^;；!?，。！？\?])",
)
CLAUSE_BOUNDARY = r"([,，.][\"’”」』]{0,2})([^,，.])"
GAP_BOUNDARY = r"([\n]{1,}| {2,}[\"’”」』]{0,2})([^\s\x1c-\x1f])"
SPACE_BOUNDARY = r"( [\"’”」』]{0,2})([^ ])"

# Java reads \s as ASCII unless asked; the control separators count as blanks too.
BLANK = r"[\s\x1c-\x1f]"


def _break(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, "(?U)" + pattern, "$1\n$2")


def trim_blanks(text: Column) -> Column:
    """Strip every kind of Unicode blank at both ends."""
    return F.regexp_replace(text, rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


def rtrim_blanks(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U){BLANK}+\z", "")


def pdf_normalise(text: Column) -> Column:
    """Recognised pages: squeeze runs of newlines, then turn every blank into a space."""
    squeezed = F.regexp_replace(text, "\n{3,}", "\n")
    return F.regexp_replace(squeezed, "(?U)" + BLANK, " ")


def _refine(pieces: Column, pattern: str, limit: int) -> Column:
    """Break the pieces above ``limit`` characters once more, leaving the others whole."""
    return F.flatten(
        F.transform(
            pieces,
            lambda piece: F.when(
                F.length(piece) > limit, F.split(_break(piece, pattern), "\n")
            ).otherwise(F.array(piece)),
        )
    )


def sentence_pieces(text: Column, limit: int = 100, pdf: bool = False) -> Column:
    """Array of sentence pieces; pieces above ``limit`` go through three finer levels."""
    if pdf:
        text = pdf_normalise(text)
    for pattern in FIRST_BOUNDARIES:
        text = _break(text, pattern)
    pieces = F.split(rtrim_blanks(text), "\n")
    for pattern in (CLAUSE_BOUNDARY, GAP_BOUNDARY, SPACE_BOUNDARY):
        pieces = _refine(pieces, pattern, limit)
    return F.filter(pieces, lambda piece: piece != "")


# --- titles -----------------------------------------------------------------


@functools.lru_cache(maxsize=1)
def numeric_letters() -> str:
    """Letters that carry a numeric value (CJK numerals), as one character class body."""
    found = (chr(code) for code in range(0x3000, sys.maxunicode + 1))
    return "".join(c for c in found if unicodedata.category(c) == "Lo" and c.isnumeric())


def is_title(text: Column, max_chars: int = 20, min_letters: float = 0.5) -> Column:
    """A short line that ends without punctuation and is mostly letters."""
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    visible = F.length(F.regexp_replace(text, "(?U)" + BLANK, ""))
    return (
        (F.length(text) > 0)
        & ~text.rlike(r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]\z")
        & (F.length(text) <= max_chars)
        & ((visible == 0) | (letters >= visible * F.lit(min_letters)))
        & ~text.rlike(r"[,.，。]\z")
        & ~text.rlike(rf"\A[\p{{N}}{numeric_letters()}]+\z")
        & F.substring(text, 1, 5).rlike(r"[\p{L}\p{N}]")
    )


# Fixed value: what stands around a title before content that follows it.
TITLE_PREFIX = ("下文与(", ")有关。")


def titled(content: Column, title: Column) -> Column:
    """Content that follows a title, prefixed with it."""
    before, after = TITLE_PREFIX
    return F.concat(F.lit(before), title, F.lit(after), content)


def titled_pieces(pieces: Column, titles: Column, inherited: Column | None = None) -> Column:
    """Array of (content, category): titles marked, what follows one prefixed with it.

    ``pieces`` is an array column and ``titles`` the positions of its titles; ``inherited``
    is the last title before this text. Each piece is visited once.
    """

    def shown(content, category=None):
        return F.struct(
            content.alias("content"), F.lit(category).cast("string").alias("category")
        )

    def segment(start, number):
        title = F.get(pieces, start)
        end = F.coalesce(F.get(titles, number + 1), F.size(pieces))
        rest = F.slice(pieces, start + 2, end - start - 1)
        return F.concat(
            F.array(shown(title, TITLE_CATEGORY)),
            F.transform(rest, lambda piece: shown(titled(piece, title))),
        )

    def opening(piece):
        if inherited is None:
            return shown(piece)
        return shown(F.when(inherited.isNull(), piece).otherwise(titled(piece, inherited)))

    head = F.slice(pieces, F.lit(1), F.coalesce(F.get(titles, F.lit(0)), F.size(pieces)))
    return F.concat(F.transform(head, opening), F.flatten(F.transform(titles, segment)))


def title_positions(pieces: Column) -> Column:
    found = F.transform(pieces, lambda piece, at: F.when(is_title(piece), at))
    return F.filter(found, lambda at: at.isNotNull())


# --- recursive token splitting ------------------------------------------------

# Separators, coarse to fine.
TOKEN_SEPARATORS = ("\n", ".", "。", "!", "！", "?", "？", "；", ";", "……", "…", "、", "，", ",", " ")


def _approximate_tokens(text: str) -> int:
    return len(text) // 4


def _cut_before(text: str, separator: str) -> list[str]:
    head, *rest = text.split(separator)
    return [part for part in [head, *(separator + tail for tail in rest)] if part]


def _pack(parts: list[str], limit: int, overlap: int, measure) -> list[str]:
    """Greedy packing of consecutive parts; each pack repeats up to ``overlap`` of the last."""
    packs, start, total = [], 0, 0
    sizes = [measure(part) for part in parts]
    for end, size in enumerate(sizes):
        if total + size > limit and end > start:
            packs.append("".join(parts[start:end]).strip())
            while total > overlap or (total + size > limit and total > 0):
                total -= sizes[start]
                start += 1
        total += size
    packs.append("".join(parts[start:]).strip())
    return [pack for pack in packs if pack]


def token_pieces(
    text: str,
    limit: int = 400,
    overlap: int = 200,
    measure=_approximate_tokens,
    separators=TOKEN_SEPARATORS,
) -> list[str]:
    """Pieces of at most ``limit`` tokens, cut at the coarsest separator that occurs."""
    usable = [i for i, s in enumerate(separators) if s in text]
    level = usable[0] if usable else len(separators) - 1
    finer = separators[level + 1 :]
    out: list[str] = []
    small: list[str] = []
    for part in _cut_before(text, separators[level]):
        if measure(part) < limit:
            small.append(part)
            continue
        if small:
            out.extend(_pack(small, limit, overlap, measure))
            small = []
        out.extend(token_pieces(part, limit, overlap, measure, finer) if finer else [part])
    if small:
        out.extend(_pack(small, limit, overlap, measure))
    return out


def token_split(pieces: Column, limit: int = 400, overlap: int = 200, measure=None) -> Column:
    """Second split of an array of pieces into one flat array of final texts.

    Arrays without a long piece stay in the JVM, where the split only strips blanks; the
    others go to Python in Arrow batches.
    """
    counter = measure or _approximate_tokens

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(arrays: pd.Series) -> pd.Series:
        def one(array):
            if array is None:
                return None
            return [t for p in array for t in token_pieces(p, limit, overlap, counter)]

        return arrays.map(one)

    if measure is not None:
        return cut(pieces)
    long = F.exists(pieces, lambda piece: F.length(piece) >= 4 * limit)
    stripped = F.filter(F.transform(pieces, trim_blanks), lambda piece: piece != "")
    return F.when(~long, stripped).otherwise(cut(F.when(long, pieces)))


# --- web pages ----------------------------------------------------------------


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


# What stands between the name and the end of a tag; a quoted value may hold ``>``.
INSIDE_TAG = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+"""


def html_text(page: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags removed, entities decoded."""
    hidden = rf"(?is)<(script|style|template|rt|rp)\b{INSIDE_TAG}>.*?</\1\s*>"
    text = F.regexp_replace(page, hidden, "")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, rf"(?s)<[a-zA-Z/!]{INSIDE_TAG}>", "")
    coded = text.contains("&")
    return F.when(coded, _unescape(F.when(coded, text))).otherwise(text)


def fold_accents(text: Column) -> Column:
    """Lower-case and drop single diacritics, as the token index does."""
    plain, bare = _accent_pairs()
    return F.translate(F.lower(text), plain, bare)


@functools.lru_cache(maxsize=1)
def _accent_pairs() -> tuple[str, str]:
    pairs = []
    for code in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and unicodedata.combining(parts[1]):
            pairs.append((chr(code), parts[0].lower()))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def tokens(text: Column) -> Column:
    """Runs of letters, digits and private-use characters, folded."""
    return F.regexp_extract_all(fold_accents(text), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), 1)

