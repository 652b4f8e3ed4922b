"""Text functions: normalisation with source offsets, clause lines, snippets, terms.

Functions named after a column take and give columns and stay in the JVM but for
composing accents, for which Spark has no function; the others are for workers.
"""

from __future__ import annotations

import re
import textwrap
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Unicode's White_Space, and those of it that break lines.
BREAKS = "\n\x0b\x0c\r\x85\u2028\u2029"
SPACES = "\t \xa0\u1680\u2000-\u200a\u202f\u205f\u3000"
_RUN = re.compile(f"[{BREAKS}{SPACES}]+")
_BREAK = re.compile(f"\r\n|[{BREAKS}]")
#: Fixed value: a line that begins a clause: "12.", "12.3", "4)", "(a)", "iv.", "Section 3", "v." before capitals.
CLAUSE_LINE = (
    r"^((?i:section|article)\s+([0-9]{1,3}(\.[0-9]{1,3})*|([ivxl]{1,5}|[IVXL]{1,5}))[.:]*(\s*$|\s+[^\p{Ll}\s].*$)"
    r"|\([A-Za-z0-9]{1,4}\)\s.*"
    r"|([A-UW-Za-uw-z]|([ivxl]{2,5}|[ixl]|[IVXL]{2,5}|[IXL]))\.\s.*"
    r"|[vV]\.\s+[^\s\p{L}]*\p{Lu}[^\s\p{L}]*\p{Lu}([^\s\p{L}]|\p{Lu})*(\s.*)?$"
    r"|[0-9]{1,3}(\.[0-9]{1,3})*\)\s.*"
    r"|[0-9]{1,3}(\.[0-9]{1,3})+\.?\s.*"
    r"|[0-9]{1,3}\.\s.*)"
)


@pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def composed(text: Column) -> Column:
    """NFC; only texts that hold a character beyond U+02FF leave the JVM."""
    return F.coalesce(_composed(F.when(text.rlike("[^\\x00-\\u02FF]"), text)), text)


def normalized(text: Column) -> Column:
    """NFC; a run of white space becomes a space, a break if it holds one, two breaks if it holds more; outer white space goes."""
    t = F.regexp_replace(composed(text), f"\r\n|[{BREAKS}]", "\n")
    t = F.regexp_replace(t, f"[{SPACES}]+", " ")
    t = F.regexp_replace(t, " ?\n ?", "\n")
    t = F.regexp_replace(t, " ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(t, "\n{2,}", "\n\n"), "^[ \n]+|[ \n]+$", "")


def joined_hyphens(text: Column) -> Column:
    """Words that a hyphen and one break cut, before a lower-case letter, joined; for normalised text of PDF files."""
    return F.regexp_replace(text, r"(?<=\p{IsAlphabetic})-\n(?=\p{IsLowercase})", "")


def is_clause_line(line: Column) -> Column:
    return line.rlike(CLAUSE_LINE)


def single_spaced(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"[{BREAKS}{SPACES}]+", " "), "^ | $", "")


def snippet(text: Column, most: int) -> Column:
    """At most that many characters on one line, cut between words with an ellipsis; a longer first word is cut."""
    flat = single_spaced(text)
    cut = F.regexp_extract(flat, f"^(.{{1,{most}}}) ", 1)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.when(cut != "", cut).otherwise(F.substring(flat, 1, most)), F.lit("…")))


def words(text: Column) -> Column:
    """Runs without white space; an empty list for blank text, null for null."""
    return F.filter(F.split(text, f"[{BREAKS}{SPACES}]+"), lambda w: w != "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_format(path: Column) -> Column:
    """pdf, docx or txt by the extension whatever its case; null for others and for names that are only an extension."""
    extension = F.lower(F.regexp_extract(file_name(path), r"[^.].*\.([^.]+)$|^\.+[^.]+\.([^.]+)$", 1))
    return F.when(extension.isin("pdf", "docx", "txt"), extension)


def safe_file_name(title: Column) -> Column:
    """Characters that file systems refuse, and blanks, become one underscore."""
    return F.regexp_replace(F.regexp_replace(title, r"[^A-Za-z0-9.&,()\-]+", "_"), "^_+|_+$", "")


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits of at most 40 bytes; an empty list for null."""
    # by split(), since regexp_extract_all took seven times as long on these documents
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(found, lambda t: (t != "") & (F.octet_length(t) <= 40))


def trigrams(text: Column) -> Column:
    """Distinct runs of three words of ASCII letters and digits, lower-cased."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda k: F.array_join(F.slice(words, k, 3), " "))
    return F.when(F.size(words) >= 3, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def page_at(pages: Column, offset: Column) -> Column:
    """Page of the last entry (off, page) that begins at or before the offset; null before the first and without pages."""
    return F.try_element_at(F.filter(pages, lambda p: p["off"] <= offset), F.lit(-1))["page"]


def wrap(text: str, width: int) -> list[str]:
    """Lines of whole words, as full as they go; a longer word has a line of its own."""
    return textwrap.wrap(" ".join(text.split()), width, break_long_words=False, break_on_hyphens=False)


@dataclass
class Normalized:
    """Normalised text and where each of its characters comes from."""

    text: str
    starts: list[int]
    ends: list[int]

    def source_range(self, start: int, end: int) -> tuple[int, int]:
        """Place in the source of a place in the text; an empty one stays empty."""
        if start >= end:
            at = self.starts[start] if start < len(self.starts) else self.ends[-1] if self.ends else 0
            return at, at
        return self.starts[start], self.ends[end - 1]


def _clusters(text: str) -> list[tuple[str, int, int]]:
    if unicodedata.is_normalized("NFC", text):
        return [(c, k, k + 1) for k, c in enumerate(text)]
    out: list[tuple[str, int, int]] = []
    at = 0
    while at < len(text):
        to = at + 1
        while to < len(text) and (unicodedata.combining(text[to]) or "\u1161" <= text[to] <= "\u11c2"):
            to += 1
        out += [(c, at, to) for c in unicodedata.normalize("NFC", text[at:to])]
        at = to
    return out


def normalize(text: str, join_hyphens: bool = False) -> Normalized:
    """normalized() and, for PDF text, joined_hyphens(), with the source of every character.

    Words are copied as wholes with their ranges of places; only text that isn't
    composed is looked at by character.
    """
    flat, first, last = text, range(len(text)), range(1, len(text) + 1)
    if not unicodedata.is_normalized("NFC", text):
        parts = _clusters(text)
        flat, first, last = "".join(c for c, _, _ in parts), [s for _, s, _ in parts], [e for _, _, e in parts]
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    at = 0
    for run in [*_RUN.finditer(flat), None]:
        start, end = run.span() if run else (len(flat), len(flat))
        word, at = flat[at:start], end
        starts += first[start - len(word) : start]
        ends += last[start - len(word) : start]
        out.append(word)
        if run is None or start == 0 or end == len(flat):
            continue
        breaks = len(_BREAK.findall(run[0])) if run[0] != " " else 0
        if join_hyphens and breaks == 1 and word.endswith("-") and word[-2:-1].isalpha() and flat[end].islower():
            out[-1] = word[:-1]
            starts.pop()
            ends.pop()
            continue
        white = "\n" * min(breaks, 2) or " "
        out.append(white)
        starts += [first[start]] * len(white)
        ends += [last[end - 1]] * len(white)
    return Normalized("".join(out), starts, ends)


def page_of(pages: list[tuple[int, int]], offset: int) -> int | None:
    at = bisect_right([p for p, _ in pages], offset)
    return pages[at - 1][1] if at else None
