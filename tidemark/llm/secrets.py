"""Secret scans: a keyword automaton, regular expressions anchored near its hits, checksums.

One pass of an Aho-Corasick automaton over the text (letters A-Z folded) finds keyword positions;
each pattern is then tried only at the positions of its own keywords. Hexadecimal runs have no
keyword and are found by their own scan. Tokens that embed a checksum (the prefixes in
``CHECKED``: 30 characters and the CRC-32 of those in six base-62 digits) count only if it fits.

Edge cases: a null or empty text has no spans. Matches of one kind never overlap; kinds may.
Repeated rows are scanned separately, whole texts always. An empty table gives an empty result.
Extra columns are ignored by the scan and kept as they are by the redaction.
Spans are code points with the end excluded.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.arrays import give_back

# The forms of the three base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS_WORD = "akia"
#: Prefixes of tokens with an embedded CRC-32: kind, prefix, characters before the checksum.
CHECKED = (
    ("github", "ghp_", 30), ("github", "gho_", 30), ("github", "ghu_", 30), ("github", "ghs_", 30), ("github", "ghr_", 30),
    ("npm", "npm_", 30),
)
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = ("assign", "access", "hex", "github", "npm")
#: Rows whose rewritten texts are held at once.
SLICE = 256

Span = tuple[int, int, int]  # start, end, place of the kind in KINDS


@lru_cache(1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        found.add_word(word, ("assign", len(word)))
    found.add_word(ACCESS_WORD, ("access", len(ACCESS_WORD)))
    for kind, prefix, _ in CHECKED:
        found.add_word(prefix, (kind, len(prefix)))
    found.make_automaton()
    return found


@lru_cache(None)
def checked_form(kind: str) -> re.Pattern:
    prefixes = "|".join(p for k, p, _ in CHECKED if k == kind)
    length = next(n for k, _, n in CHECKED if k == kind)
    return re.compile(f"(?:{prefixes})([0-9A-Za-z]{{{length}}})([0-9A-Za-z]{{6}})(?![0-9A-Za-z])")


def base62(value: int, width: int = 6) -> str:
    digits = ""
    while value:
        value, rest = divmod(value, 62)
        digits = BASE62[rest] + digits
    return digits.rjust(width, "0")


def checksum_fits(body: str, check: str) -> bool:
    return base62(zlib.crc32(body.encode())) == check


def scan_text(text: str) -> list[Span]:
    """All spans of a text, by start and then kind."""
    folded = text.encode("ascii", "replace").lower().decode("ascii")  # a character for each code point
    hits: dict[str, list[int]] = {}
    for last, (kind, length) in automaton().iter(folded):
        hits.setdefault(kind, []).append(last - length + 1)
    spans: list[Span] = []
    for kind, starts in hits.items():
        place, end = KINDS.index(kind), 0
        for start in sorted(starts):
            if start < end:
                continue
            if kind == "assign":
                if match := ASSIGN.match(text, start):
                    end = match.end()
                    if len(match[2]) >= 6:
                        spans.append((start, end, place))
            elif kind == "access":
                if match := ACCESS.match(text, start):
                    end = match.end()
                    if end - start >= 20:
                        spans.append((start, end, place))
            elif (match := checked_form(kind).match(text, start)) and checksum_fits(match[1], match[2]):
                end = match.end()
                spans.append((start, end, place))
    spans += [(*match.span(), KINDS.index("hex")) for match in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], s[2], s[1]))


def span_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, end, kind in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each merged span replaced by the kind that starts it."""
    parts, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]]) if spans else text


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in range(5)]
        for text in batch.column("text"):
            spans = scan_text(text.as_py() or "")
            base = [s for s in spans if s[2] < 3]
            for kind in range(3):
                columns[kind].append(sum(s[2] == kind for s in base))
            columns[3].append(hashlib.sha256(span_text(base).encode()).hexdigest())
            columns[4].append(span_text(spans))
        counts = [pa.array(c, pa.int64()) for c in columns[:3]]
        texts = [pa.array(c, pa.string()) for c in columns[3:]]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, *texts], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, their digest, and all spans."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(_scan_batches, schema)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The documents with their secrets replaced; other columns stay. A null text stays null."""
    columns = docs.columns

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for low in range(0, batch.num_rows, SLICE):
                part = batch.slice(low, SLICE)
                texts = [None if (t := x.as_py()) is None else redact(t, scan_text(t)) for x in part.column("text")]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in columns], columns)
        give_back()

    return docs.mapInArrow(batches, docs.schema)
