"""Writing a test set: contract texts as they are, the list of files, categories and spans."""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_test_set(contracts: DataFrame, spans: DataFrame, folder: str | Path) -> int:
    """Texts of contracts (title, text) as files below documents/, docs.txt, categories.tsv and spans.tsv; the number of contracts.

    A test set is small by nature; it is written from the driver, one contract at
    a time.  Two titles that give one file name are an error.
    """
    out = Path(folder)
    (out / "documents").mkdir(parents=True, exist_ok=True)
    names: dict[str, str] = {}
    for r in contracts.orderBy("title").toLocalIterator():
        name = file_name_of(r.title)
        if name in names.values():
            raise ValueError(f"two contracts named {name}")
        names[r.title] = name
        (out / "documents" / name).write_bytes(r.text.encode())
    (out / "docs.txt").write_text("".join(f"{n}\n" for n in sorted(names.values())))
    counts = spans.groupBy("category").agg(F.countDistinct("title").alias("contracts")).orderBy("category").collect()
    (out / "categories.tsv").write_text("category\tcontracts\n" + "".join(f"{r.category}\t{r.contracts}\n" for r in counts))
    rows = spans.orderBy("category", "title", "char_start", "char_end").collect()
    (out / "spans.tsv").write_text("".join(f"{r.category}\t{names[r.title]}\t{r.char_start}\t{r.char_end}\n" for r in rows if r.title in names))
    return len(names)


def file_name_of(title: str) -> str:
    """A name that every file system takes."""
    return re.sub("[^A-Za-z0-9.&,()-]+", "_", title).strip("_") + ".txt"


def has_checksum(path: str | Path, sha256: str) -> bool:
    """Whether a file, of a model for instance, is the one that was meant."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest() == sha256.lower()


def peak_memory_mb() -> float:
    """Most memory that this process, the driver's Python, has held."""
    import resource

    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
