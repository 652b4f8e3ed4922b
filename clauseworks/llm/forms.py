"""Consistent form of text: one string for all texts that read the same.

The script step resolves every letter to the set of scripts in which a letter
of that look exists, intersects these sets over a token and spells the token in
the one script that remains.  A token that could be spelled wholly in several
scripts takes that of its neighbours with one script, which are the same before
and after any substitution.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of one look, from Unicode's public list of confusables: a Latin letter and that of the other script.
_LOOK_ALIKES = {
    "Cyrillic": "aа cс eе iі jј oо pр sѕ xх yу hһ dԁ qԛ wԝ AА BВ CС EЕ HН IІ JЈ KК MМ OО PР SЅ TТ XХ YУ QԚ WԜ lӏ",
    "Greek": "aα iι oο pρ uυ vν AΑ BΒ EΕ ZΖ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ YΥ XΧ cϲ jϳ",
    "Armenian": "oօ uս hհ nո",
}
#: The same, but rarer or less alike: such a letter can be Latin, but no Latin word is spelled with it.
_ONE_WAY = {
    "Cyrillic": "vѵ rг bЬ GԌ VѴ",
    "Greek": "FϜ",
    "Armenian": "qզ gց",
    "Cherokee": "DᎠ RᎡ TᎢ iᎥ AᎪ JᎫ EᎬ WᎳ MᎷ HᎻ GᏀ ZᏃ VᏙ SᏚ LᏞ CᏟ PᏢ KᏦ BᏴ",
}
#: Latin letters and hyphens that only look like the common one.
_SAME_SCRIPT = {"ɡ": "g", "ɑ": "a", "ƒ": "f", "‐": "-", "‑": "-"}
#: Format characters (Cf) that are drawn.
_DRAWN = re.compile("[؀-؅۝܏࢐࢑࣢\U000110bd\U000110cd]")
#: Characters without width outside the classes Cf and Cc.
_BLANK = re.compile("[͏ᅟᅠ឴឵᠋-᠍᠏ㅤﾠ︀-️\U000e0100-\U000e01ef]")


def _look_alikes() -> dict[str, dict[str, str]]:
    rows: dict[str, dict[str, str]] = {}
    for script, pairs in _LOOK_ALIKES.items():
        for latin, other in pairs.split(" "):
            rows.setdefault(latin, {"Latin": latin})[script] = other
    both = {c: row for row in rows.values() for c in row.values()}
    return both | {other: {"Latin": latin, script: other} for script, pairs in _ONE_WAY.items() for latin, other in pairs.split(" ")}


def _script(c: str) -> str:
    n = ord(c)
    if n < 0x250 or 0x250 <= n < 0x2B0 or 0x1E00 <= n < 0x1F00:
        return "Latin"
    if 0x370 <= n < 0x400 or 0x1F00 <= n < 0x2000:
        return "Greek"
    if 0x400 <= n < 0x530 or 0x1C80 <= n < 0x1C90 or 0xA640 <= n < 0xA6A0:
        return "Cyrillic"
    if 0x13A0 <= n < 0x1400 or 0xAB70 <= n < 0xABC0:
        return "Cherokee"
    return "Armenian" if 0x530 <= n < 0x590 else "other"


_ALIKE = _look_alikes()


class _Table(dict):
    """Code point to what stands for it, found when first needed."""

    def __missing__(self, n: int) -> str | int | None:
        c = chr(n)
        kind = unicodedata.category(c)
        shape = unicodedata.decomposition(c)
        to: str | int | None = n
        if c.isspace() and not "\x1c" <= c <= "\x1f":
            to = " "
        elif c in _SAME_SCRIPT:
            to = _SAME_SCRIPT[c]
        elif kind == "Cc" or kind == "Cf" and not _DRAWN.match(c) or _BLANK.match(c):
            to = None
        elif shape.startswith(("<wide>", "<narrow>")) or shape.startswith("<") and kind[0] in "LN" and not shape.startswith(("<super>", "<sub>", "<circle>", "<fraction>", "<square>")):
            to = unicodedata.normalize("NFKC", c)
        self[n] = to
        return to


_TABLE = _Table()
#: Anything but what is certain to stay as it is.
_ODD = re.compile("[^\t\n\r -~À-ıЀ-҂Ҋ-ԯ一-鿿]+")
_CONTROL = re.compile("[\0-\x08\x0e-\x1f\x7f]")
_OTHER_SCRIPT = re.compile("[Ͱ-֏Ꭰ-᏿ᲀ-᲏ἀ-῿Ꙁ-ꚟꭰ-ꮿ]")
_TOKEN = re.compile("(?:[^\\W\\d_][̀-ͯ]*)+")
_WORD = re.compile(r"[^\W_]+")
_MEMO: dict[str, dict[str, str]] = {}
_MEMO_MOST = 200_000


def _spellings(token: str) -> dict[str, str]:
    """Spelling of a token in each script that has letters of all these looks; none if no script has."""
    if (to := _MEMO.get(token)) is None:
        letters = unicodedata.normalize("NFD", token)
        choices = [_ALIKE.get(c) or {_script(c): c} for c in letters if not unicodedata.combining(c)]
        scripts = set.intersection(*map(set, choices)) - {"other"}
        to = {s: unicodedata.normalize("NFC", "".join(_ALIKE.get(c, {}).get(s, c) for c in letters)) for s in sorted(scripts)}
        if len(_MEMO) >= _MEMO_MOST:
            _MEMO.clear()
        _MEMO[token] = to
    return to


class Confusables(NamedTuple):
    """Tokens of a text that mix scripts and that one script spells, that mix scripts no one of which spells them, and that were spelled wholly in another script."""

    mixed: int
    unresolved: int
    whole: int


def _scripts(token: str) -> set[str]:
    return {_script(c) for c in unicodedata.normalize("NFD", token) if not unicodedata.combining(c)} - {"other"}


def _one_script(text: str, seen: list[str] | None = None) -> str:
    """Every token in its one script; of several, in that of the nearest tokens with one if these agree, else in Latin.

    What is found goes into seen, a word for each token: mixed, unresolved or whole.
    """
    tokens = list(_TOKEN.finditer(text))
    choices = [_spellings(m[0]) for m in tokens]
    after: list[str] = []
    near = ""
    for c in reversed(choices):
        after.append(near)
        near = next(iter(c)) if len(c) == 1 else near
    parts, at, before = [], 0, ""
    for m, c, behind in zip(tokens, choices, reversed(after), strict=True):
        if len(c) > 1:
            script = before if before in c and before == (behind or before) else behind if not before and behind in c else "Latin" if "Latin" in c else next(iter(c))
            to = c[script]
        else:
            to = next(iter(c.values()), m[0])
            before = next(iter(c), before)
        if seen is not None and (to != m[0] or not c):
            if len(_scripts(m[0])) > 1:
                seen.append("mixed" if c else "unresolved")
            elif to != m[0]:
                seen.append("whole")
        if to != m[0]:
            parts += [text[at : m.start()], to]
            at = m.end()
    return "".join([*parts, text[at:]])


def confusables(text: str | None) -> Confusables:
    """What look-alike letters a text holds."""
    seen: list[str] = []
    if text and not text.isascii():
        text = unicodedata.normalize("NFC", _ODD.sub(lambda m: m[0].translate(_TABLE), text))
        if _OTHER_SCRIPT.search(text):
            _one_script(text, seen)
    return Confusables(*(seen.count(k) for k in Confusables._fields))


def consistent_form(text: str | None) -> str | None:
    """The consistent form; None for None, "" for blank text.

    Case, accents, punctuation and raised or lowered characters stay.
    """
    if text is None:
        return None
    if text.isascii():
        return " ".join((_CONTROL.sub("", text) if _CONTROL.search(text) else text).split())
    text = unicodedata.normalize("NFC", _ODD.sub(lambda m: m[0].translate(_TABLE), text))
    if _OTHER_SCRIPT.search(text):
        text = _one_script(text)
    return " ".join(text.split())


_ASCII_WORDS = bytes(n if chr(n).isalnum() and n < 128 else 32 for n in range(256))


def form_words(text: str | None) -> list[str]:
    """Words of a text: runs of letters and digits of its lower-cased consistent form."""
    if not text:
        return []
    form = consistent_form(text).lower()
    return form.encode().translate(_ASCII_WORDS).decode().split() if form.isascii() else _WORD.findall(form)


_BETWEEN = re.compile(r"[^\W_](?:[^\w\s!-~]*[^\W_])*")


def word_offsets(text: str) -> list[tuple[int, int]] | None:
    """Place of every word of form_words(text) in the text as stored; None where the words can't be told apart there.

    Characters are read in clusters, a letter with the marks and the characters
    without width that follow it; a cluster's form is what stands for it.
    """
    out: list[tuple[int, int]] = []
    start = end = None
    at = 0
    while at < len(text):
        to = at + 1
        while to < len(text) and (unicodedata.combining(text[to]) or text[to].translate(_TABLE) == ""):
            to += 1
        form = unicodedata.normalize("NFC", text[at:to].translate(_TABLE))
        for k, c in enumerate(form):
            if c.isalnum():
                start, end = at if start is None else start, to
            elif start is not None and not (k and unicodedata.combining(c) and _ALIKE.get(form[0])):
                out.append((start, end))
                start = None
        at = to
    if start is not None:
        out.append((start, end))
    return out if len(out) == len(form_words(text)) else None


def digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def with_forms(df: DataFrame, key: str, text: str = "text", full: bool = True) -> DataFrame:
    """key, form, tokens mixed, unresolved and whole (these four left out unless full), form_hash and text_hash of every row whose key and text aren't null."""
    found = ", ".join(f"{c} int" for c in Confusables._fields)
    schema = f"{key} bigint, " + f"form string, {found}, " * full + "form_hash binary, text_hash binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            forms = list(map(consistent_form, texts))
            more = [pa.array(forms, pa.string()), *(pa.array(c, pa.int32()) for c in zip(*map(confusables, texts), strict=True))] if full and texts else [pa.nulls(0, pa.string()), *[pa.nulls(0, pa.int32())] * 3] * full
            columns = [b.column(0), *more, pa.array(map(digest, forms), pa.binary()), pa.array(map(digest, texts), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, *["form", *Confusables._fields] * full, "form_hash", "text_hash"])

    rows = df.select(F.col(key).cast("bigint").alias(key), F.col(text).alias("text")).where(f"{key} is not null and text is not null")
    return rows.mapInArrow(run, schema)


def _hashes(df: DataFrame, key: str) -> DataFrame:
    return with_forms(df, key, full=False)


def equal_forms(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Pairs of a left and a right row of one consistent form whose stored texts differ.

    Only 16-byte digests are shuffled.  Rows without key or text have no pair;
    repeated rows count once; blank texts share the empty form.  Rows of one form
    are spelled out as pairs; form_classes stays small where they are many.
    """
    a = _hashes(left, left_key).withColumnRenamed("text_hash", "left_hash")
    b = _hashes(right, right_key).withColumnRenamed("text_hash", "right_hash")
    return a.join(b, "form_hash").where("left_hash <> right_hash").select(left_key, right_key).distinct()


def form_classes(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """form_hash, left_rows, right_rows, spellings of every form that both sides have, stored in several spellings: a row a form, added up where the rows are."""
    sides = [_hashes(x, k).select("form_hash", "text_hash", F.col(k).alias("key"), F.lit(n).alias("side")).dropDuplicates(["side", "key", "text_hash"]) for n, (x, k) in enumerate(((left, left_key), (right, right_key)))]
    each = sides[0].unionByName(sides[1]).groupBy("form_hash", "text_hash").agg(F.count_if(F.col("side") == 0).alias("l"), F.count_if(F.col("side") == 1).alias("r"))
    return each.groupBy("form_hash").agg(F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows"), F.count("*").alias("spellings")).where("left_rows > 0 and right_rows > 0 and spellings > 1")
