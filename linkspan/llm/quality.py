"""Line-first quality rules.

Every line is judged by itself (symbols, shouting, navigation, boilerplate, repeats); lines
that fail are removed, and a document that loses too much of its text is rejected.
"""

from __future__ import annotations

import re
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspan.llm.common import over_batches

#: A document must keep at least this share of its words.
KEEP_SHARE = 0.5
MIN_WORDS = 10
#: A line fails if more than this share of its characters other than white space are no letters, marks on letters, or digits.
PUNCTUATION_SHARE = 0.25
#: A line fails if boilerplate phrases make up at least this share of its characters.
BOILERPLATE_SHARE = 0.1
#: A line of capitals fails if it has this many words and at least half of them end in '!'.
SHOUT_WORDS = 3
#: A line of so few words fails if it has a navigation separator between them.
NAVIGATION_WORDS = 12
_SYMBOLS = tuple(b"#*$%&|<>"[i : i + 1] for i in range(8))
_SPACES = (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")
_NAVIGATION = re.compile(r"\S\s*(?:\||»|›|::|>)\s*\S.*(?:\||»|›|::|>)\s*\S")
_BOILERPLATE = re.compile(
    r"all rights reserved|terms of (?:use|service)|privacy policy|cookie (?:policy|settings)|(?:uses?|accept) cookies|enable javascript"
    r"|lorem ipsum|click here to|subscribe to our|sign up for our|share (?:this )?on (?:facebook|twitter)|powered by",
    re.IGNORECASE,
)
_LETTERS = re.compile(r"[^\W_]+")


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """How many words lie in a window of ``width`` words that occurs at least twice, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, len(words))
    # exact window numbers: mixed radix, ranked anew before they would pass 64 bits
    rank, bound = ids[:n], len(known)
    for k in range(1, width):
        if bound * len(known) >= 2**63:
            rank, bound = np.unique(rank, return_inverse=True)[1].astype(np.uint64), n
        rank, bound = rank * np.uint64(len(known)) + ids[k : k + n], bound * len(known)
    _, place, count = np.unique(rank, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[place] > 1)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + width, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def bad_line(line: str) -> bool:
    """Whether a line's own content fails: symbols, shouting, navigation or boilerplate."""
    words = line.split()
    solid = sum(map(len, words))
    alnum = sum(map(len, _LETTERS.findall(line)))
    if solid - alnum > PUNCTUATION_SHARE * solid and (line.isascii() or solid - alnum - sum(category(c)[0] == "M" for c in line) > PUNCTUATION_SHARE * solid):
        return True
    if len(words) >= SHOUT_WORDS and line.isupper() and 2 * sum(w.endswith("!") for w in words) >= len(words):
        return True
    if len(words) <= NAVIGATION_WORDS and _NAVIGATION.search(line):
        return True
    phrases = sum(map(len, _BOILERPLATE.findall(line)))
    return phrases > 0 and phrases >= BOILERPLATE_SHARE * len(line)


def judge(text: str | None) -> tuple[dict[str, int | bool], str]:
    """The base counts and both verdicts of a text, and the text less its failed lines.

    A null text counts as one without words: base_failed, not kept.
    """
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    repeat = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeat > 20 * len(words)
    seen: set[str] = set()
    kept_lines, kept_words, dup_lines = [], 0, 0
    for line in text.split("\n"):
        n = len(line.encode("utf-8", "surrogatepass").split())
        if not n:
            kept_lines.append(line)
            continue
        again = line in seen
        dup_lines += again
        seen.add(line)
        if not again and not bad_line(line):
            kept_lines.append(line)
            kept_words += n
    counts = {
        "n_words": len(words), "word_chars": len(text) - sum(map(raw.count, _SPACES)),
        "n_symbols": sum(map(raw.count, _SYMBOLS)), "n_dup_lines": dup_lines, "n_repeat_words": repeat, "base_failed": failed,
        "kept": not failed and kept_words >= KEEP_SHARE * len(words),
    }
    return counts, "\n".join(kept_lines)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def rules(docs: DataFrame) -> DataFrame:
    """The base counts and verdicts of every row, from its whole text, of any length (see ``judge``).

    A null text counts as empty. Repeated rows are each judged; columns beyond doc_id and text
    are ignored; an empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [judge(x)[0] for x in batch.column(1).to_pylist()]
        names = list(found[0])
        values = [pa.array([f[n] for f in found], pa.bool_() if n in ("base_failed", "kept") else pa.int64()) for n in names]
        return pa.RecordBatch.from_arrays([batch.column(0), *values], names=["doc_id", *names])

    return over_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)


def clean(docs: DataFrame) -> DataFrame:
    """The rows, all columns, that the rules keep, with failed lines removed from ``text``.

    A null or wordless text is not kept; repeated rows are each judged. An empty table gives an
    empty result.
    """
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [judge(x) for x in batch.column(at).to_pylist()]
        out = batch.set_column(at, batch.schema.field(at), pa.array([t for _, t in found], batch.schema.field(at).type))
        return out.filter(pa.array([f["kept"] for f, _ in found], pa.bool_()))

    return over_batches(docs, run, docs.schema)
