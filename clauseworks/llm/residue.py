"""Template residue, filler and error pages, by naive Bayes learnt from positive and unlabelled passages.

A text is cut into passages (lines, sentences, runs of one repeated word) and
marks (a few words or a bullet between brackets or other delimiters).  Each kind
has its model: of passages words and pairs of neighbouring words are terms, of
marks delimiters, shape and words.  Passages and marks that a short list of
patterns trusts are the positive examples, all others are unlabelled;
expectation-maximisation gives the unlabelled ones their share of the positive
class.  The patterns only label: what counts is decided by the learnt odds alone.
A record is residue if any of its passages or marks is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from math import log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forms import consistent_form

#: Documents, drawn by the hash of doc_id, whose passages and marks are all used, and whose trusted ones are.
SAMPLE, TRUSTED_SAMPLE = 5_000, 20_000
#: Trusted rows of a kind below which they are sought beyond the sample, in WIDER times as many documents each time, up to all.
LEAST_TRUSTED, WIDER = 100, 8
ROUNDS, LEAST_COUNT = 5, 2


class Weights(NamedTuple):
    """Most weight of an unlabelled example in the positive class, least in the other, and weight of the terms' overall shares, in terms."""

    positive: float
    negative: float
    smooth: float


#: Unlabelled examples weigh little in the positive class, so that what is merely unusual can't form a class of its own.
PASSAGES, MARKS = Weights(0.003, 0.5, 300.0), Weights(0.03, 0.5, 30.0)
#: Log odds from which a passage or a mark counts, and the mean of a passage's terms from which it does: ordinary
#: wording that happens to share some words with a message mixes terms of either sign.
PASSAGE_ODDS, MARK_ODDS, TERM_ODDS = 1.0, 0.0, 3.0

_BREAK = "␞"
_LINES = re.compile("\r\n?|[\n\x0b\x0c\x85  ]")
_REPEATED = re.compile(r"(?<!\w)([^\W\d_]{2,}) \1 \1(?: \1)*(?!\w)", re.IGNORECASE)
_CUT = re.compile(rf" ?{_BREAK} ?|(?<=[.!?]) (?=[^\Wa-z])")
_TERM = re.compile(r"[^\W_]+|[\"“”]")
_MARK = re.compile(
    r"(?P<open>\{\{|\{%|[$#]?\{|<%=?|<\?=?|<<?|\[\[?|\$\$|@@|(?<![\w%])%|(?<!\w)__(?=[^\W_])|\((?=(?i:fill|insert|enter|tb[cda]|your)\b))"
    r" ?(?P<bullet>[•●*]+(?= ?[\]\w]))? ?(?P<inner>\$?[^\W\d_][\w.: ]{0,39}?)? ?"
    r"(?P<close>\}\}|%\}|\}|%>|\?>|>>?|\]\]?|\$\$|@@|%(?!\w)|__(?!\w)|\))"
    r"|(?<!\w)(?P<date>(?:XX|DD|MM)([/.-])(?:XX|MM|DD)\6(?:\d\dXX|XX(?:XX)?|YY(?:YY)?))(?!\w)"
)
#: Marks that hold anything else up to their own delimiter on the line, however long, sought where none of the above is.
#: Quoted keys in braces are data, attributes and addresses in angles and XML declarations are markup.
_WIDE_KINDS = [(o, rf"(?:(?!{o}|{c})[^{_BREAK}])+", c) for o, c in ((r"\{\{", r"\}\}"), (r"\{%", "%}"), (r"<%=?", "%>"), (r"<\?=?(?!xml)", r"\?>"), ("<<", ">>"), (r"\[\[", r"\]\]"))] + [
    (r"[$#]\{", rf"[^{{}}{_BREAK}]+", r"\}"),
    (r"\$\$", rf"(?=[^\W\d])[^${_BREAK}]+", r"\$\$"),
    ("@@", rf"(?=[^\W\d])[^@{_BREAK}]+", "@@"),
    (r"(?<![\w%])%", rf"(?=[^\W\d])[^\s%{_BREAK}]+", r"%(?!\w)"),
    (r"(?<!\w)__", rf"(?=[^\W\d_])[^\s{_BREAK}]+?", r"__(?!\w)"),
    (r"(?<![{$#])\{(?![{%])", rf"[^{{}}\"“”;{_BREAK}]+", r"\}"),
    (r"(?<!<)<", rf"(?=[^\W\d])(?!\w+:/)[^<>\"“”=@;{_BREAK}]*[^<>\"“”=@;/{_BREAK}]", ">"),
    (r"(?<!\[)\[(?!\[)", rf"(?:[^\[\]{_BREAK}]|\[\d+\])+", r"\]"),
    (r"\(", rf"(?=(?i:fill|insert|enter|tb[cda]|your)\b)[^(){_BREAK}]+", r"\)"),
]
_WIDE = re.compile("|".join(rf"(?P<open{k}>{o})(?P<inner{k}>{i})(?P<close{k}>{c})" for k, (o, i, c) in enumerate(_WIDE_KINDS)))
_MAY_HOLD_MARK = re.compile(r"[\[{<$@●•]|__|%\w|(?:XX|DD|MM)[/.-]|\((?i:fill|insert|enter|tb[cda]|your)\b")
#: Marks that are trusted to be placeholders: delimiters of template languages, and words that ask for a value.
_TRUSTED_OPEN = {"{{", "{%", "${", "#{", "<%", "<%=", "<?", "<?=", "<<", "[[", "$$", "@@", "__", "%", "<", "{"}
_ASKS = re.compile(r"(?i)^(?:insert|fill in|enter|tb[cd]\b)|\bto be (?:completed|inserted|confirmed)$|\bhere$|^object Object$")
_ALWAYS_TEMPLATE = {"{{", "{%", "${", "#{", "<%", "<%=", "<?", "<?="}
_ASKS_AT_LENGTH = re.compile(r"(?i)^(?:insert|fill in|enter|tb[cd])\b|\bto be (?:completed|inserted|confirmed)$")
#: One of several names, as in [Party A/Party B].
_CHOICE = re.compile(r"[A-Z][a-z]{2,}(?: [A-Z][a-z]*){0,3}(?: ?/ ?[A-Z][a-z]{2,}(?: [A-Z][a-z]*){0,3})+")
#: Characters from which a wide mark is long.
LONG_MARK = 40
#: Passages that are trusted to be filler or messages.
_TRUSTED = re.compile(
    r"(?i)\blorem ipsum\b|(?:^|\W)(?:error|fehler|erreur|http error)\W{0,3}[45]\d\d\b|^(?:.{0,40}\W)?[45]\d\d (?:not found|forbidden|bad gateway|gateway timeout|request timeout|service unavailable|internal server error|too many requests|gone|unauthorized|bad request)\b"
    r"|\b(?:enable|turn on|activate|activez|active|aktivieren sie) javascript\b|\bjavascript (?:must|needs to|has to) be (?:enabled|turned on|activated)(?=\W*$| to | in your | for this )|\btraceback \(most recent|\boops\W+something went wrong\b|\bsomething went wrong on our\b|\baccess denied\W|\bdown for maintenance\b|\bchecking your browser\b|\ballow cookies\b"
    r"|\byour text (?:goes )?here\b|\bdummy paragraph\b|\bplaceholder copy\b|^sample text\W|\breplace this (?:paragraph|text)\b"
)
#: Terms that are defined, owed or forbidden are spoken of, but not where a message speaks to its reader or of itself.
_SPOKEN_OF = re.compile(
    r"(?i)[\"“”][^\"“”]{1,60}[\"“”].{0,40}\bmeans?\b|\b(?P<modal>"
    r"(?<!\byou )(?<!\bwe )(?<!\bit )(?<!\bjavascript )(?<!\bscripts )(?<!\bscripting )(?<!\bcookies )(?<!\bbrowser )(?<!\bthis page )(?<!\bthis site )(?<!\bthis website )(?<!\bthis document )"
    r"(?:must|may|will)|(?:(?<=\byou )|(?<=\bwe ))(?:must|may|will)(?= (?:not|never) (?!be\b|have\b|see\b))|shall|agrees?) (?:not |never |[a-z]+ly )?(?!stand\b|have been\b|no longer\b|be back\b|be available again\b)[a-z]+\b"
)
#: Where a new clause begins, unless what stands before is a condition of it.
_CLAUSE = re.compile(r"[;:] | [-–—] |, (?=(?:or|otherwise|but|and|so|as|because)\b)", re.IGNORECASE)
_CONDITION = re.compile(r"(?i)\W*(?:\w\) )?(?:where|if|when|whenever|should|unless|until|upon|once|while|in case|in the event|for|after|before|during|subject)\b")
_SENTENCE = re.compile(r"[.!?] ")


class WideMark(NamedTuple):
    open: str
    inner: str
    close: str


def passages(text: str) -> tuple[list[str], list[re.Match | WideMark]]:
    """Passages and marks of a text.  What a wide mark holds is a passage, too, as it may be a whole sentence."""
    form = consistent_form(_LINES.sub(_BREAK, text)) or ""
    marks: list[re.Match | WideMark] = []
    if _MAY_HOLD_MARK.search(form):
        marks += [m for m in _MARK.finditer(form) if m["inner"] or m["bullet"] or m["date"]]
        for m in marks:
            form = form.replace(m[0], _BREAK)
        for m in _WIDE.finditer(form):
            k = m.lastgroup.removeprefix("close")
            if any(c.isalpha() for c in m[f"inner{k}"]):
                marks.append(WideMark(m[f"open{k}"], m[f"inner{k}"].strip(), m[f"close{k}"]))
    if _REPEATED.search(form):
        form = _REPEATED.sub(lambda m: f"{_BREAK}{m[0]}{_BREAK}", form)
    return [p for p in _CUT.split(form) if p], marks


def passage_terms(passage: str) -> list[str]:
    terms = [t if t.isalpha() else t if t == '"' else "0" * len(t) if t.isdigit() and len(t) < 4 else "<number>" if t.isdigit() else "<code>" for t in _TERM.findall(passage.lower())]
    if len(terms) > 2 and len(set(terms)) * 3 <= len(terms):
        terms = [*sorted(set(terms)), *["<repeated>"] * 3]
    return terms


def mark_terms(m: re.Match | WideMark) -> list[str]:
    if isinstance(m, WideMark):
        terms = [f"open {m.open}", f"close {m.close}", "bullet ", "long" if len(m.inner) > LONG_MARK else "short", *sorted({f"holds {c}" for c in m.inner if not c.isalnum() and c != " "})]
        return terms + [f"in {w}" for w in re.split(r"[\W_]+", m.inner.lower()) if w]
    if m["date"]:
        return ["date"] * 3
    inner = m["inner"] or ""
    shape = "upper" if inner.isupper() else "lower" if inner.islower() else "title" if inner.istitle() else "mixed"
    terms = [f"open {m['open']}", f"close {m['close']}", f"bullet {(m['bullet'] or '')[:1]}"]
    return terms + ([f"shape {shape}", *[f"in {w}" for w in re.split(r"[\W_]+", inner.lower()) if w]] if inner else [])


def _trusted_mark(m: re.Match | WideMark) -> bool:
    if isinstance(m, WideMark):
        name = len(m.inner) <= LONG_MARK and not re.search(r"[,;]", m.inner)
        return m.open in _ALWAYS_TEMPLATE or m.open in _TRUSTED_OPEN and name or bool(_ASKS_AT_LENGTH.search(m.inner)) or m.open == "[" and bool(_CHOICE.fullmatch(m.inner))
    inner = m["inner"] or ""
    return bool(m["date"]) or bool(inner) and (m["open"] in _TRUSTED_OPEN or bool(_ASKS.search(inner)) or m["bullet"] in ("•", "●")) or not inner and m["bullet"] in ("•", "●")


def spoken_of(passage: str) -> bool:
    """Whether all that the patterns trust here, if anything, stands in clauses that define, owe or forbid something.

    Such a clause reaches from where it or its condition begins to the end of the sentence, lists included.
    """
    found = list(_SPOKEN_OF.finditer(passage))
    if not found:
        return False
    scopes = []
    for m in found:
        start = max((e.end() for e in _SENTENCE.finditer(passage, 0, m.start())), default=0)
        for c in _CLAUSE.finditer(passage, start, m.start()):
            if not _CONDITION.match(passage, start):
                start = c.end()
        end = _SENTENCE.search(passage, m.end())
        scopes.append((start, end.start() if end else len(passage)))
    return all(any(a <= t.start() < b for a, b in scopes) for t in _TRUSTED.finditer(passage))


def trusted(passage: str) -> bool:
    return bool(_TRUSTED.search(passage)) and not spoken_of(passage)


def with_pairs(terms: list[str]) -> list[str]:
    """Terms and pairs of neighbours, the ends among them."""
    return terms + [f"{x} {y}" for x, y in zip(["^", *terms], [*terms, "$"], strict=True)]


def fit(rows: list[tuple[bool, list[str]]], weights: Weights) -> dict[str, float]:
    """Log odds of each term, and of the class at "", from (trusted, terms) rows.

    No trusted row gives no term and odds that nothing reaches.
    """
    if not any(t for t, _ in rows):
        return {"": -1e9}
    number = Counter(chain.from_iterable(terms for _, terms in rows))
    # what stands in one example only tells nothing, unless that is a trusted one
    sure = {w for t, terms in rows if t for w in terms}
    ids = {w: k for k, w in enumerate(w for w, n in number.items() if n >= LEAST_COUNT or w in sure)}
    get = ids.get
    lengths = np.array([len(terms) for _, terms in rows])
    term = np.fromiter((get(w, -1) for _, terms in rows for w in terms), np.int32, int(lengths.sum()))
    at = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)[term >= 0]
    term = term[term >= 0]
    overall = np.bincount(term, minlength=len(ids)) / max(1, len(term))
    trusted = np.array([t for t, _ in rows])
    share = trusted.astype(float)
    # few trusted terms are not to be drowned by the overall shares
    smooth = min(weights.smooth, float(lengths[trusted].sum()))
    for _ in range(ROUNDS):
        pos, neg = (np.bincount(term, x[at], len(ids)) + smooth * overall for x in (np.where(trusted, 1.0, weights.positive * share), np.where(trusted, 0.0, 1 - (1 - weights.negative) * share)))
        odds = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
        prior = log((share.sum() + 1) / (len(rows) - share.sum() + 1))
        score = prior + np.bincount(at, odds[term], len(rows))
        share = np.where(trusted, 1.0, 1 / (1 + np.exp(-np.clip(score, -50, 50))))
    return {"": prior} | {w: float(odds[k]) for w, k in ids.items()}


class PassageModel:
    """Learnt odds of words and pairs, and for each word a bound of what it and the pair it begins can add."""

    def __init__(self, odds: dict[str, float]) -> None:
        self.odds = odds
        self.most = {w: x for w, x in odds.items() if w and " " not in w}
        begins: dict[str, float] = {}
        for pair, x in odds.items():
            if " " in pair:
                word = pair.split(" ", 1)[0]
                begins[word] = max(begins.get(word, 0.0), x)
        for word, x in begins.items():
            self.most[word] = self.most.get(word, 0.0) + x

    def score(self, passage: str) -> float | None:
        """Log odds of a passage that counts; None for one that doesn't, most of them by the bound alone."""
        terms = passage_terms(passage)
        get, prior = self.most.get, self.odds[""]
        least = max(PASSAGE_ODDS - prior, TERM_ODDS * (2 * len(terms) + 1))
        if get("^", 0.0) + sum([get(t, 0.0) for t in terms]) < least:
            return None
        get = self.odds.get
        own = sum([get(t, 0.0) for t in with_pairs(terms)])
        return prior + own if own >= least else None


def mark_odds(model: dict[str, float], m: re.Match | WideMark) -> float:
    return model[""] + sum(model.get(t, 0.0) for t in mark_terms(m))


_HASHES = 1 << 31


def _labelled(texts: DataFrame, low: int, high: int, only_trusted: bool) -> DataFrame:
    """Rows to fit to, of the documents whose hash of doc_id is in [low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, sure, terms = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cut, marks = passages(text)
                for p in cut:
                    if (t := trusted(p)) or not only_trusted:
                        kinds.append(0), sure.append(t), terms.append("\n".join(passage_terms(p)))
                for m in marks:
                    if (t := _trusted_mark(m)) or not only_trusted:
                        kinds.append(1), sure.append(t), terms.append("\n".join(mark_terms(m)))
                # a run of one word is trusted whatever the word
                for p in cut:
                    if _REPEATED.fullmatch(p) and len(p.split(" ")) > 4:
                        kinds.append(0), sure.append(True), terms.append("\n".join(passage_terms(p)))
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(sure, pa.bool_()), pa.array(terms, pa.string())], names=["kind", "trusted", "terms"])

    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(_HASHES))
    return texts.where((hashed >= low) & (hashed < high)).mapInArrow(run, "kind int, trusted boolean, terms string")


def _sampled(texts: DataFrame, documents: int) -> list:
    """Rows of about SAMPLE documents, the trusted ones of TRUSTED_SAMPLE, and of further documents those of a kind that is rare among these."""
    high, far = (min(_HASHES, max(1, n * _HASHES // max(1, documents))) for n in (SAMPLE, TRUSTED_SAMPLE))
    rows = _labelled(texts, 0, high, False).collect()
    rows += _labelled(texts, high, far, True).collect() if far > high else []
    high = far
    while high < _HASHES:
        number = Counter(r.kind for r in rows if r.trusted)
        short = [k for k in (0, 1) if number[k] < LEAST_TRUSTED]
        if not short:
            break
        low, high = high, min(_HASHES, high * WIDER)
        rows += _labelled(texts, low, high, True).where(F.col("kind").isin(short)).collect()
    return rows


def residue_scores(documents: DataFrame) -> DataFrame:
    """doc_id, passage_odds and mark_odds (the highest of each, of passages that count only; null without any) of every document with text.

    A passage counts from PASSAGE_ODDS and a mean of TERM_ODDS a term.  Null,
    empty and blank texts have no row; doc_id null neither; a doc_id that occurs
    again has one row for each.  The models are fitted on samples of about SAMPLE
    and TRUSTED_SAMPLE documents, and where trusted examples of a kind are rare
    there, on those of further documents; every document is scored whole.
    """
    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = _sampled(texts, documents.count())
    split = ([(r.trusted, r.terms.split("\n")) for r in rows if r.kind == k] for k in (0, 1))
    models = PassageModel(fit([(t, with_pairs(x)) for t, x in next(split)], PASSAGES)), fit(next(split), MARKS)
    del rows
    sent = texts.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passage_model, mark_model = sent.value
        for b in batches:
            ids, best, best_mark = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cut, marks = passages(text)
                if not cut and not marks:
                    continue
                ids.append(doc)
                best.append(max((x for p in cut if (x := passage_model.score(p)) is not None), default=None))
                best_mark.append(max((mark_odds(mark_model, m) for m in marks), default=None))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(best, pa.float64()), pa.array(best_mark, pa.float64())], names=["doc_id", "passage_odds", "mark_odds"])

    return texts.mapInArrow(run, "doc_id bigint, passage_odds double, mark_odds double")


def residue_documents(documents: DataFrame) -> DataFrame:
    """doc_id of every document that holds residue, once each."""
    return residue_scores(documents).where((F.col("passage_odds") >= PASSAGE_ODDS) | (F.col("mark_odds") >= MARK_ODDS)).select("doc_id").distinct()
