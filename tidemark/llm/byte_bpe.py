"""Byte-level BPE by a lazily determinised transducer, and a streaming decoder.

Merges by rank are compiled on demand into a transducer over the bytes of one pre-token. Its
state is the last token emitted and the bytes read since: a token sequence is the encoding of its
bytes exactly if each neighbouring pair is the encoding of its own bytes, so the last token of
every prefix follows from the last tokens of shorter prefixes. A state keeps those as a row, which
the states that follow it share, and is made when a text first leads there. Beyond a bounded
lookahead, whatever part of the sequence all continuations share is emitted; no continuation
reaches further back than the longest token that can still be completed. States, and the outputs
of whole pre-tokens, are kept in tables of bounded size.

Decoding joins the tokens' bytes and feeds them to an incremental UTF-8 decoder, which holds back
an incomplete character until its last byte arrives.

Edge cases: a null or empty text has no tokens and decodes to nothing. Repeated rows are encoded
separately, whole texts always. An empty table gives an empty result. Special tokens are ordinary
text. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.arrays import give_back

MOST_PAIRS = 400_000
MOST_STATES = 200_000
MOST_PIECES = 350_000
#: Rows whose ids are held at once.
SLICE = 256
LOOKAHEAD = 64
NEVER = 1 << 60


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        #: Every end of a token: its rank if it is a token itself, else -1.
        self.tails = {token[n:]: -1 for token in ranks for n in range(1, len(token))} | ranks
        self._edges: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self._pairs: dict[int, bool] = {}  # by left << 32 | right
        self._rows: dict[bytes, list[int | None]] = {}

    @cached_property
    def prefixes(self) -> set[bytes]:
        """What a token may begin with; only pieces beyond the lookahead ask."""
        return {token[:n] for token in self.ranks for n in range(1, len(token))}

    def halves(self, token: bytes) -> tuple[bytes, bytes]:
        """The two parts that the last merge of a token joined."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, i = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NEVER:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) != 2 or max(map(self.ranks.__getitem__, parts)) > self.ranks[token]:
            raise ValueError(f"{token!r} is not the outcome of merges in order of rank")
        return parts[0], parts[1]

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What lies at the left (0) or right (1) end of a token while it is merged: from one byte
        to the whole, each with the rank of the merge that ends it."""
        if (known := self._edges[side].get(token)) is None:
            part, ends, known = self.tokens[token], NEVER, []
            while True:
                known.append((part, ends))
                if len(part) == 1:
                    break
                ends, part = self.ranks[part], self.halves(part)[side]
            self._edges[side][token] = known = known[::-1]
        return known

    def may_follow(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border when both tokens' bytes are merged together."""
        if left < 0:
            return True
        key = left << 32 | right
        if (known := self._pairs.get(key)) is None:
            if len(self._pairs) >= MOST_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._border_holds(self.edge(left, 1), self.edge(right, 0))
        return known

    def _border_holds(self, left: list[tuple[bytes, int]], right: list[tuple[bytes, int]]) -> bool:
        """Both ends grow in order of rank; of equal ranks the merge further left comes first."""
        i = j = 0
        while True:
            (a, a_ends), (b, b_ends) = left[i], right[j]
            across = self.ranks.get(a + b, NEVER)
            if across < a_ends and across <= b_ends and across != NEVER:
                return False
            if a_ends == b_ends == NEVER:
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1

    def last_token(self, last: list[int | None], pending: bytes) -> int | None:
        """The last token of the encoding of ``pending``, from those of its prefixes; None where
        that encoding does not pass through the last token emitted. Ends of ``pending`` are tried only
        as far as some token ends like them."""
        tails, start, found = self.tails, len(pending) - 1, []
        while start >= 0 and (token := tails.get(pending[start:])) is not None:
            if token >= 0 and last[start] is not None:
                found.append((last[start], token))
            start -= 1
        pairs = self._pairs
        for before, token in reversed(found):
            holds = before < 0 or pairs.get(before << 32 | token)
            if holds or (holds is None and self.may_follow(before, token)):
                return token
        return None

    def path(self, last: list[int | None], end: int) -> list[int]:
        """Ends of the tokens that cover the first ``end`` bytes, in order."""
        ends = []
        while end:
            ends.append(end)
            end -= len(self.tokens[last[end]])
        return ends[::-1]

    def settled(self, last: list[int | None], pending: bytes) -> list[int]:
        """Ends of the tokens that all places where a later token may start have in common."""
        size = len(pending)
        starts = [i for i in range(max(0, size - self.longest), size) if last[i] is not None and pending[i:] in self.prefixes] + [size]
        common = self.path(last, starts[0])
        for start in starts[1:] if common else ():
            own = self.path(last, start)
            n = next((i for i, (a, b) in enumerate(zip(common, own)) if a != b), min(len(common), len(own)))
            common = common[:n]
        return common

    def known_state(self, piece: bytes, limit: int) -> tuple[int, list[int | None]]:
        """The longest prefix whose state has been made before, and its row of last tokens."""
        for end in range(limit, 0, -1):
            if (row := self._rows.get(piece[:end])) is not None:
                return end, row[: end + 1]
        return 0, [-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        limit = min(len(piece), LOOKAHEAD)
        at, last = self.known_state(piece, limit)
        if len(self._rows) >= MOST_STATES:
            self._rows.clear()
        for end in range(at + 1, limit + 1):
            prefix = piece[:end]
            last.append(self.last_token(last, prefix))
            self._rows[prefix] = last  # a longer prefix goes on in the same row
        out, pending = [], piece[:limit]
        for i in range(limit, len(piece)):
            pending += piece[i : i + 1]
            last.append(self.last_token(last, pending))
            if len(pending) >= 2 * LOOKAHEAD and (ends := self.settled(last, pending)):
                out += [last[end] for end in ends]
                pending, last = pending[ends[-1] :], last[ends[-1] :]
        return out + [last[end] for end in self.path(last, len(pending))]


class Pieces(dict):
    """Packed ids of pre-tokens, encoded when first asked for; of the short ones so many are kept."""

    def __init__(self, transducer: Transducer, most: int):
        self.transducer, self.most = transducer, most

    def __missing__(self, piece: str) -> bytes:
        ids = self.transducer.encode(piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) >= self.most:
                for old in list(islice(self, self.most // 2)):
                    del self[old]
            self[piece] = packed
        return packed


#: Texts of these characters alone are split by the faster pattern below, which agrees with the
#: public pattern on them: no numeral but the digits 0-9, and no white space that engines dispute.
PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]*")
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
PLAIN_FOR = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Codec:
    """Encodes texts to packed little-endian ids and decodes them again."""

    def __init__(self, path: str, pattern: str, most: int = MOST_PIECES):
        import regex

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.split_any = regex.compile(pattern).findall
        self.split_plain = re.compile(PLAIN_PATTERN).findall if pattern == PLAIN_FOR else self.split_any
        self.transducer = Transducer(ranks)
        self.vocabulary = [self.transducer.tokens.get(i, b"") for i in range(max(self.transducer.tokens) + 1)]
        self._pieces = Pieces(self.transducer, most)

    def split(self, text: str) -> list[str]:
        return self.split_plain(text) if PLAIN.fullmatch(text) else self.split_any(text)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self._pieces.__getitem__, self.split(text)))

    def forget(self) -> None:
        """Empties the tables; a worker process goes on to other work after a task."""
        self._pieces.clear()
        self.transducer._rows.clear()
        self.transducer._pairs.clear()
        give_back()

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode_stream(codec: Codec, chunks: Iterable[bytes]) -> Iterator[str]:
    """Text of a stream of packed ids; a character comes out once its last byte has arrived."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    for ids in chunks:
        yield machine.decode(codec.decode_bytes(ids))
    yield machine.decode(b"", True)


@lru_cache(2)
def codec(path: str, pattern: str, most: int = MOST_PIECES) -> Codec:
    """One codec for each worker process; its vocabulary outlives a task."""
    return Codec(path, pattern, most)


def _default(path: str | None, pattern: str | None) -> tuple[str, str]:
    if path and pattern:
        return path, pattern
    import public_tokenizers as public

    return path or public.path("byte_bpe_multi_50k.tiktoken"), pattern or public.PATTERN


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and its packed ids (little-endian unsigned 32-bit integers)."""
    path, pattern = _default(path, pattern)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in (whole.slice(low, SLICE) for whole in rows for low in range(0, whole.num_rows, SLICE)):
            ids = [own.encode(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])
        own.forget()

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(batches, "doc_id long, ids binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, chunk: int = 1 << 16, keep_ids: bool = False, remembered: int | None = None) -> DataFrame:
    """Encodes and decodes in one pass: doc_id, n_tokens and the digests of ids and decoded text;
    with ``keep_ids`` the packed ids too. Tables are emptied after each task, for what the worker
    does next; with ``remembered`` they outlive it, and so many outputs of pre-tokens are kept."""
    path, pattern = _default(path, pattern)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, remembered or MOST_PIECES)
        for batch in (whole.slice(low, SLICE) for whole in rows for low in range(0, whole.num_rows, SLICE)):
            counts, encoded, decoded, packed = [], [], [], []
            for text in batch.column("text"):
                ids, digest = own.encode(text.as_py() or ""), hashlib.sha256()
                for part in decode_stream(own, (ids[i : i + chunk] for i in range(0, len(ids), chunk))):
                    digest.update(part.encode())
                if keep_ids:
                    packed.append(ids)
                counts.append(len(ids) // 4)
                encoded.append(hashlib.sha256(ids).hexdigest())
                decoded.append(digest.hexdigest())
            arrays = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                arrays, names = [*arrays, pa.array(packed, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)
        if not remembered:
            own.forget()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(batches, schema)
