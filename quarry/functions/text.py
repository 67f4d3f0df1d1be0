"""Text functions: Column in, Column out, all of them built-in expressions.

Regular expressions carry (?U) so that white space and case are Unicode's, with U+001C..U+001F
added to white space; (?d) keeps the newline as the only line end.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f]"

# The characters of a token, the spellings of an article header, the name that
# articles are given, and the phrases (unaccented) that count as a refusal.
TOKEN_CLASS = "0-9a-zA-ZÀ-ỹ"
ARTICLE_SPELLINGS = ("điều", "die[uú]", "dieu", "ðieu", "ðiều")
ARTICLE_NAME = "Điều "
REFUSALS = ("khong tim thay can cu", "khong du can cu", "khong co thong tin", "ngoai pham vi")


HANGUL, LEADS, VOWELS, TAILS = 0xAC00, range(0x1100, 0x1113), range(0x1161, 0x1176), range(0x11A7, 0x11C3)


@cache
def _folding() -> tuple[str, str, dict[str, str]]:
    """Arguments of ``translate``: characters that decompose to one base letter, then all
    nonspacing marks, which have no counterpart and are deleted; and what decomposes to several
    letters, Hangul syllables left out."""
    source, target, marks, several = [], [], [], {}
    for code in (*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1)):
        ch = chr(code)
        if HANGUL <= code < HANGUL + 11172:
            continue
        if unicodedata.category(ch) == "Mn":
            marks.append(ch)
            continue
        if not unicodedata.decomposition(ch):
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")
        if len(base) > 1:
            several[ch] = base
        elif base != ch:
            source.append(ch)
            target.append(base)
    source += ["đ", "Đ"]
    target += ["d", "D"]
    return "".join(source + marks), "".join(target), several


def _letters(ch: Column) -> Column:
    """What one character decomposes to, where that is several letters."""
    several = _folding()[2]
    listed = lambda codes: F.array(*(F.lit(chr(c)) for c in codes))
    at = F.ascii(ch) - HANGUL  # the code point
    tail = F.when(at % 28 == 0, "").otherwise(F.get(listed(TAILS), at % 28))
    syllable = F.concat(F.get(listed(LEADS), F.floor(at / 588).cast("int")), F.get(listed(VOWELS), F.floor(at % 588 / 28).cast("int")), tail)
    table = F.create_map(*(F.lit(x) for pair in several.items() for x in pair))
    return F.when(at.between(0, 11171), syllable).otherwise(F.coalesce(F.try_element_at(table, ch), ch))


def strip_accents(col: Column) -> Column:
    """Canonical decomposition without nonspacing marks; đ and Đ become d and D. Texts with characters that
    decompose to several letters (Hangul, vowel signs of two parts and the like) are taken character by character."""
    source, target, several = _folding()
    spelled = F.array_join(F.transform(F.regexp_extract_all(col, F.lit("(?s)(.)"), F.lit(1)), _letters), "")
    rare = F.regexp(col, F.lit(f"[{_ranges([*several, chr(HANGUL), chr(HANGUL + 11171)])}]"))
    ascii_only = F.octet_length(col) == F.length(col)
    return F.when(ascii_only, col).otherwise(F.translate(F.when(rare, spelled).otherwise(col), source, target))


def _ranges(characters: list[str], gap: int = 0x400) -> str:
    """Few ranges of a character class that hold them all, and others near them."""
    out: list[list[int]] = []
    for code in sorted(map(ord, characters)):
        if out and (code - out[-1][1] < gap or HANGUL <= out[-1][1] and code < HANGUL + 11172):
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in out)


def normalize(col: Column) -> Column:
    return F.lower(strip_accents(col))


def tokenize(col: Column) -> Column:
    """Array of tokens in order, duplicates kept; null for null."""
    return F.regexp_extract_all(normalize(col), F.lit(f"([{TOKEN_CLASS}]+)"), F.lit(1))


#: What WS matches under (?U).
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACES))


def clean_text(col: Column) -> Column:
    """Line ends to newlines, runs of blanks and tabs to one blank, no blank lines, no white
    space at line starts or at either end."""
    has = lambda x, part: F.contains(x, F.lit(part))  # noqa: E731  a search of bytes, so that most texts meet no pattern
    out = F.replace(col, F.lit("\f"), F.lit("\n"))
    out = F.when(has(out, "\r"), F.regexp_replace(out, r"\r\n?", "\n")).otherwise(out)
    out = F.when(has(out, "\t") | has(out, "  "), F.regexp_replace(out, r" *\t[ \t]*| {2,}", " ")).otherwise(out)
    return strip(F.regexp_replace(out, rf"(?U)\n{WS}+", "\n"))


def short_text(col: Column, limit: int = 220) -> Column:
    """One line of at most ``limit`` characters, ending in an ellipsis if clipped."""
    flat = strip(F.regexp_replace(col, rf"(?U){WS}+", " "))
    head = F.regexp_replace(F.substring(flat, 1, limit - 3), rf"(?U){WS}+\z", "")
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(head, F.lit("...")))


def escape_cell(col: Column, limit: int = 120) -> Column:
    """A Markdown table cell."""
    return F.replace(short_text(col, limit), F.lit("|"), F.lit("\\|"))


def article_pattern(spellings: tuple[str, ...] = ARTICLE_SPELLINGS) -> str:
    return rf"(?imdU)^{WS}*(?:{'|'.join(spellings)}){WS}+([0-9]+[a-zA-Z]?){WS}*[\.:]?{WS}*(.*)$"


def find_articles(col: Column, spellings: tuple[str, ...] = ARTICLE_SPELLINGS, name: str = ARTICLE_NAME) -> Column:
    """Array of (article, title) for the header lines, in order."""
    pattern = F.lit(article_pattern(spellings))
    numbers, titles = (F.regexp_extract_all(col, pattern, F.lit(g)) for g in (1, 2))
    return F.zip_with(numbers, titles, lambda n, t: F.struct(F.concat(F.lit(name), n).alias("article"), F.nullif(strip(t), F.lit("")).alias("title")))


def last_article(col: Column, spellings: tuple[str, ...] = ARTICLE_SPELLINGS, name: str = ARTICLE_NAME) -> Column:
    """The last header of a text, or null. The text is searched once, for whole headers."""
    pattern = article_pattern(spellings)
    line = F.try_element_at(F.regexp_extract_all(col, F.lit(pattern), F.lit(0)), F.lit(-1))
    number, title = (F.regexp_extract(line, pattern, g) for g in (1, 2))
    return F.when(line.isNotNull(), F.struct(F.concat(F.lit(name), number).alias("article"), F.nullif(strip(title), F.lit("")).alias("title")))


def paragraphs(col: Column) -> Column:
    """Array of cleaned, non-empty paragraphs of a cleaned text: it breaks at blank lines and
    after lines that end in a full stop."""
    parts = F.split(col, rf"(?U)(?<=\.)\n|\n{WS}*\n")
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def citation(page_start: Column, page_end: Column, article: Column) -> Column:
    pages = F.when(page_start == page_end, page_start.cast("string")).otherwise(F.concat_ws("-", page_start, page_end))
    tail = F.when(article.isNotNull() & (article != ""), F.concat(F.lit(", "), article)).otherwise("")
    return F.concat(F.lit("Trang "), pages, tail)


def contains_normalized(text: Column, expected: Column, strict: bool = False) -> Column:
    """Whether ``expected`` is part of ``text``, both normalised; null
    texts match nothing. ``strict`` asks for a border after it, so 3 is not found in 35."""
    found = F.contains(text, expected)
    if strict:
        found = F.regexp(text, F.concat(F.lit(r"(?U)\Q"), expected, F.lit(r"\E(?![0-9a-z])")))
    return F.coalesce(found, F.lit(False))


def article_matches(text: Column, expected: Column, strict: bool = False) -> Column:
    """Whether the normalised ``expected`` is part of the normalised ``text``, which must not be empty."""
    return contains_normalized(nonempty(text), normalize(expected), strict)


def nonempty(text: Column) -> Column:
    """The normalised text, null for an empty one."""
    return F.when(text != "", normalize(text))


def has_citation(answer: Column) -> Column:
    return F.regexp(answer, F.lit(r"(?iU)\[(?:trang|page)\s+\d+"))


def is_refusal(answer: Column, normalized: bool = False) -> Column:
    norm = answer if normalized else normalize(answer)
    out = F.lit(False)
    for phrase in REFUSALS:
        out = out | F.contains(norm, F.lit(phrase))
    return out


def keyword_hits(answer: Column, keywords: Column, normalized: bool = False) -> Column:
    """The normalised keywords that are part of the normalised answer, duplicates kept."""
    norm = answer if normalized else normalize(answer)
    return F.filter(F.transform(keywords, normalize), lambda k: F.contains(norm, k))
