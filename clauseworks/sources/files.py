"""Files of a folder: walking, hashing, text of TXT, DOCX and PDF files."""

from __future__ import annotations

import hashlib
import io
import os
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Formats, the size limit, and below the least text of a page.
FORMATS = ("pdf", "docx", "txt")
MOST_BYTES = 50 * 1024 * 1024
#: Visible characters a page must have on average for a PDF file to count as one with a text layer.
LEAST_VISIBLE = 100
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def format_of(name: str) -> str | None:
    """Format by the extension whatever its case; a name that is only an extension has none."""
    extension = os.path.splitext(name)[1][1:].lower()
    return extension if extension in FORMATS else None


@dataclass
class Found:
    path: str
    format: str
    size: int
    mtime: int


@dataclass
class Walk:
    found: list[Found] = field(default_factory=list)
    skipped: list[tuple[str, str]] = field(default_factory=list)


def walk(root: str | Path, leave_out: Callable[[Path], bool] | None = None) -> Walk:
    """Files below a folder, each folder's entries by name, depth first; what can't be used is skipped with a reason.

    Links below the root aren't followed; folders that leave_out names are
    passed over without a word.
    """
    out = Walk()

    def visit(folder: Path) -> None:
        try:
            entries = sorted(os.scandir(folder), key=lambda e: os.fsencode(e.name))
        except OSError as e:
            out.skipped.append((str(folder), e.strerror or str(e)))
            return
        for entry in entries:
            path = Path(entry.path)
            if entry.is_symlink():
                out.skipped.append((entry.path, "symbolic link"))
            elif entry.is_dir():
                if not (leave_out and leave_out(path)):
                    visit(path)
            elif entry.name.startswith("~$"):
                out.skipped.append((entry.path, "lock file of an office program"))
            elif (kind := format_of(entry.name)) is None:
                out.skipped.append((entry.path, "unsupported format"))
            else:
                try:
                    stat = entry.stat()
                    out.found.append(Found(entry.path, kind, stat.st_size, max(0, int(stat.st_mtime))))
                except OSError as e:
                    out.skipped.append((entry.path, e.strerror or str(e)))

    if not Path(root).is_dir():
        raise NotADirectoryError(str(root))
    visit(Path(root))
    return out


@dataclass
class Extracted:
    """Text, and (offset, number) of the pages where the format has pages."""

    text: str
    pages: list[tuple[int, int]] = field(default_factory=list)


class Unreadable(Exception):
    """A file without usable text; the message is the reason."""


def extract_txt(content: bytes) -> Extracted:
    """UTF-8 with replacement characters for what isn't, without a leading byte-order mark."""
    return Extracted(content.decode("utf-8", "replace").removeprefix("﻿"))


def _run_text(node: ElementTree.Element) -> str:
    parts = []
    for child in node:
        tag = child.tag.removeprefix(_W)
        if tag == "t":
            parts.append(child.text or "")
        elif tag in ("tab", "ptab"):
            parts.append("\t")
        elif tag in ("br", "cr"):
            parts.append("\n")
        elif tag == "noBreakHyphen":
            parts.append("-")
    return "".join(parts)


def _paragraph_text(node: ElementTree.Element) -> str:
    """Runs in order, also those in links, insertions, moved-to text and content controls; deleted and moved-from text is left out."""
    parts = []
    for child in node:
        tag = child.tag.removeprefix(_W)
        if tag == "r":
            parts.append(_run_text(child))
        elif tag in ("hyperlink", "ins", "moveTo", "smartTag", "sdt", "sdtContent", "fldSimple"):
            parts.append(_paragraph_text(child))
    return "".join(parts)


def _paragraphs(node: ElementTree.Element) -> Iterator[str]:
    for child in node:
        tag = child.tag.removeprefix(_W)
        if tag == "p":
            yield _paragraph_text(child)
        elif tag in ("tbl", "tr", "tc", "sdt", "sdtContent", "ins", "moveTo", "customXml"):
            yield from _paragraphs(child)


def extract_docx(content: bytes) -> Extracted:
    """Paragraphs of the body, of nested tables and content controls, too, joined by blank lines; blank ones are dropped."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as file:
            body = ElementTree.fromstring(file.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise Unreadable(f"not a DOCX file: {e}") from e
    return Extracted("\n\n".join(p for p in _paragraphs(body if body is not None else ElementTree.Element("body")) if p.strip()))


def joined_pages(pages: list[str]) -> Extracted:
    """Pages joined by blank lines, with their starts; too little visible text means there is no text layer."""
    starts, at = [], 0
    for number, page in enumerate(pages, 1):
        starts.append((at, number))
        at += len(page) + 2
    text = "\n\n".join(pages)
    if sum(not c.isspace() for c in text) < LEAST_VISIBLE * max(1, len(pages)):
        raise Unreadable("no text layer")
    return Extracted(text, starts)


def extract_pdf(content: bytes) -> Extracted:
    """Text page by page; one that can't be decoded is empty.  An encrypted file is tried with the empty password.  Needs pypdf."""
    try:
        import pypdf
    except ImportError as e:
        raise Unreadable("PDF files need the pypdf package") from e
    try:
        reader = pypdf.PdfReader(io.BytesIO(content))
        if reader.is_encrypted and not reader.decrypt(""):
            raise Unreadable("encrypted")
        pages = []
        for page in reader.pages:
            try:
                pages.append(page.extract_text() or "")
            except Exception:  # noqa: BLE001 - a page's fault is no fault of the file
                pages.append("")
    except Unreadable:
        raise
    except Exception as e:  # noqa: BLE001 - parsers fail in many ways
        raise Unreadable(f"PDF can't be read: {e}") from e
    return joined_pages(pages)


EXTRACTORS: dict[str, Callable[[bytes], Extracted]] = {"txt": extract_txt, "docx": extract_docx, "pdf": extract_pdf}


def extract(path: str, kind: str) -> tuple[bytes, Extracted]:
    """SHA-256 of a file and its text; Unreadable if it is too large, can't be opened or parsed."""
    try:
        if os.path.getsize(path) > MOST_BYTES:
            raise Unreadable("larger than 50 MB")
        content = Path(path).read_bytes()
    except OSError as e:
        raise Unreadable(e.strerror or str(e)) from e
    try:
        return hashlib.sha256(content).digest(), EXTRACTORS[kind](content)
    except Unreadable:
        raise
    except Exception as e:  # noqa: BLE001 - one file's parser must not end a task
        raise Unreadable(f"{type(e).__name__}: {e}") from e


SCHEMA = "position bigint, path string, format string, hash binary, mtime bigint, text string, pages array<struct<off:int,page:int>>, error string"


def read_files(spark: SparkSession, found: list[Found]) -> DataFrame:
    """A row for every file, in the walk's order by position: its text or the reason why there is none (error).

    Only paths are listed on the driver; contents are read where the tasks are,
    which must see the folder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for position, path, kind, mtime in zip(*(c.to_pylist() for c in b.columns), strict=True):
                digest, text, pages, error = None, None, None, None
                try:
                    digest, got = extract(path, kind)
                    text, pages = got.text, [{"off": o, "page": p} for o, p in got.pages]
                except Unreadable as e:
                    error = str(e)
                row = {"position": position, "path": path, "format": kind, "hash": digest, "mtime": mtime, "text": text, "pages": pages, "error": error}
                yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

    listed = spark.createDataFrame([(k, f.path, f.format, f.mtime) for k, f in enumerate(found)], "position bigint, path string, format string, mtime bigint")
    return listed.repartition(max(1, min(len(found), spark.sparkContext.defaultParallelism * 4))).mapInArrow(run, SCHEMA)


_ARROW = pa.schema([("position", pa.int64()), ("path", pa.string()), ("format", pa.string()), ("hash", pa.binary()), ("mtime", pa.int64()), ("text", pa.string()), ("pages", pa.list_(pa.struct([("off", pa.int32()), ("page", pa.int32())]))), ("error", pa.string())])
