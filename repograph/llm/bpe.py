"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece of text exactly one token can be the last of its encoding: the token that ends there whose neighbour to the
left, the last token of what remains, forms a valid pair with it (encoding the two tokens' bytes gives back the two tokens). Storing that
token for each prefix gives the encoding of all prefixes at once. Bytes can therefore be appended exactly, and after an edit only the
prefixes from the edit on are done again, up to where the stored tokens agree with those from before for as long as a token can be.

A text is cut into pieces by the vocabulary's pattern first. Each task keeps the encodings of pieces that it has seen in a bounded table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Pieces that a Python worker remembers, about; a second table of this size holds those from before. Longer pieces than LONGEST are not remembered.
#: The fewer are for encode_documents, beside which a worker hands on whole rows.
REMEMBERED, FEWER, LONGEST = 300_000, 100_000, 64
#: Pairs of tokens, for each piece remembered, of which a worker remembers whether they stay apart.
PAIRS = 2
#: Documents that are encoded and handed on together.
TOGETHER = 128
SHIFT = 24
#: The letters, numbers and white space below U+0250.
LATIN_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
LATIN_NUMBERS = "0-9²³¹¼-¾"
LATIN_SPACE = "\t-\r \u0085 "


class PrefixEncoder:
    """Encodes pieces of bytes by ranks (bytes of a token to its id; a smaller id merges first)."""

    def __init__(self, ranks: dict[bytes, int], pairs: int = PAIRS * REMEMBERED):
        self.ranks, self.pairs = ranks, pairs
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self._halves: dict[int, tuple[int, int]] = {}
        #: By the left token's number, shifted by SHIFT, and the right one's.
        self._valid: dict[int, bool] = {}

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; a single byte is its own halves."""
        if (found := self._halves.get(token)) is None:
            parts = [self.bytes[token][i : i + 1] for i in range(len(self.bytes[token]))]
            while len(parts) > 2:
                merges = [(self.ranks.get(a + b, token), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
                rank, i = min(merges)
                if rank >= token:
                    raise ValueError(f"no merges lead to token {token}")
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            found = self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[-1]])
        return found

    def valid(self, left: int, right: int) -> bool:
        """Whether the bytes of the two tokens are encoded as these two tokens."""
        if (known := self._valid.get(left << SHIFT | right)) is None:
            if len(self._valid) > self.pairs:
                self._valid.clear()
            known = self._valid[left << SHIFT | right] = self._stays_apart(left, right)
        return known

    def _stays_apart(self, left: int, right: int) -> bool:
        # Undo the merges on both sides of the seam, latest first. The seam would have been closed if at some time the tokens
        # beside it could merge before the merge that replaced one of them.
        limit = len(self.ranks) + 1
        while True:
            merged = self.ranks.get(self.bytes[left] + self.bytes[right])
            if merged is not None and merged < limit:
                return False
            left_inner, right_inner = self.halves(left)[1], self.halves(right)[0]
            can_left, can_right = left_inner != left, right_inner != right
            if not can_left and not can_right:
                return True
            if can_left and (left > right or not can_right):
                limit, left = left, left_inner
            else:
                limit, right = right + 1, right_inner

    def extend(self, piece: bytes, last: list[int], upto: int) -> None:
        """Append to last (the last token of each prefix of piece, from length 1) until it has upto entries."""
        ranks, known, longest = self.ranks.get, self._valid.get, self.longest
        for end in range(len(last) + 1, upto + 1):
            for start in range(max(0, end - longest), end):
                if (token := ranks(piece[start:end])) is None:
                    continue
                if start and not known((left := last[start - 1]) << SHIFT | token) and not self.valid(left, token):
                    continue
                last.append(token)
                break
            else:
                raise ValueError("a byte is missing in the vocabulary")

    def prefixes(self, piece: bytes) -> list[int]:
        last: list[int] = []
        self.extend(piece, last, len(piece))
        return last

    def tokens(self, last: list[int]) -> list[int]:
        """The encoding that the last tokens of all prefixes stand for."""
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.bytes[last[at - 1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        if (token := self.ranks.get(piece)) is not None:
            return [token]
        return self.tokens(self.prefixes(piece))

    def appended(self, piece: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """Piece and last tokens after more bytes; only the new prefixes are worked out."""
        piece, last = piece + more, list(last)
        self.extend(piece, last, len(piece))
        return piece, last

    def edited(self, piece: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """Piece and last tokens after piece[start:end] became new; stops where old and new agree for good."""
        after = piece[:start] + new + piece[end:]
        out, shift, agreed = last[:start], end - start - len(new), 0
        while len(out) < len(after) and agreed < self.longest:
            self.extend(after, out, len(out) + 1)
            agreed = agreed + 1 if len(out) > start + len(new) and out[-1] == last[len(out) - 1 + shift] else 0
        return after, out + last[len(out) + shift :] if len(out) < len(after) else out

    def decode(self, tokens: list[int]) -> bytes:
        return b"".join([self.bytes[t] for t in tokens])


class Splitter:
    """The matches of the vocabulary's pattern in a text, in order; they cover the text."""

    def __init__(self) -> None:
        # Python's \s and \d differ from those of the pattern's own engine, hence explicit classes.
        def fill(letters: str, numbers: str, space: str) -> str:
            named = {r"[^\s\p{L}\p{N}]": f"[^{space}{letters}{numbers}]", r"\p{L}": f"[{letters}]", r"\p{N}": f"[{numbers}]", r"\S": f"[^{space}]", r"\s": f"[{space}]"}
            return re.sub("|".join(map(re.escape, named)), lambda m: named[m[0]], public_tokenizers.PATTERN)

        self.latin = re.compile(fill(LATIN_LETTERS, LATIN_NUMBERS, LATIN_SPACE))
        self.any = regex.compile(fill(r"\p{L}", r"\p{N}", r"\p{White_Space}"))
        self.beyond_latin = re.compile("[^\x00-ɏ]")

    def __call__(self, text: str) -> list[str]:
        return (self.any if self.beyond_latin.search(text) else self.latin).findall(text)


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Tokens and ranks of a vocabulary file: one base64 token and its rank a line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


class Memory(dict):
    """Pieces with what ``made`` makes of their ids, in two generations of bounded size."""

    def __init__(self, encoder: PrefixEncoder, made: Callable, size: int):
        super().__init__()
        self.encoder, self.made, self.size, self.old = encoder, made, size, {}

    def __missing__(self, piece: str):
        if (found := self.old.get(piece)) is None:
            found = self.made(self.encoder, self.encoder.encode(piece.encode("utf-8")))
        if len(piece) <= LONGEST:
            self[piece] = found
        return found

    def of(self, pieces: list[str]) -> list:
        found = [*map(self.__getitem__, pieces)]
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()
        return found


def packed(encoder: PrefixEncoder, ids: list[int]) -> bytes:
    return np.array(ids, dtype="<i4").tobytes()


def written(encoder: PrefixEncoder, ids: list[int]) -> tuple[str, bytes]:
    """The ids as text and the bytes that they decode to."""
    return " ".join(map(str, ids)), encoder.decode(ids)


def _workers(raw: bytes, made: Callable, size: int) -> tuple[Splitter, Memory]:
    """What a Python worker keeps between batches: one vocabulary and one kind of memory."""
    if _KEPT.get("for") != (raw, made.__name__):
        _KEPT.clear()
        _KEPT.update({"for": (raw, made.__name__), "splitter": Splitter(), "memory": Memory(PrefixEncoder(read_ranks(raw), PAIRS * size), made, size)})
    return _KEPT["splitter"], _KEPT["memory"]


_KEPT: dict = {}


def _vocabulary(df: DataFrame, path: str | None):
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        # One file of a fixed size, under 1 MB.
        return df.sparkSession.sparkContext.broadcast(f.read())


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, TOGETHER):
            yield batch.slice(a, TOGETHER)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with ``ids`` (array of int), the encoding of each whole text; a null text counts as empty and has none.

    No special tokens are added or recognised. Repeated rows are encoded alike. All other columns stay as they are, nulls and doc_ids of any type
    included; a column of docs named ids is replaced. Ids are handed on TOGETHER documents at a time.
    """
    vocabulary, docs = _vocabulary(docs, path), docs.drop("ids")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, memory = _workers(vocabulary.value, packed, FEWER)
        for batch in _slices(batches):
            ids = [b"".join(memory.of(splitter(text or ""))) for text in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
            flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), flat)], names=[*batch.schema.names, "ids"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(encode, f"{schema}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded(doc_id, ids) as doc_id (of any type, or null) and ``decoded`` (binary); null ids give no bytes."""
    vocabulary = _vocabulary(encoded, path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _workers(vocabulary.value, packed, FEWER)[1].encoder
        for batch in _slices(batches):
            decoded = [encoder.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(decoded, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {_kind(encoded, 'doc_id')}, decoded binary")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each whole text: encoding and decoding in one pass over the text.

    A null text counts as empty; a doc_id of any type, or null, stays as it is; repeated rows give the same digests.
    """
    vocabulary = _vocabulary(docs, path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, memory = _workers(vocabulary.value, written, REMEMBERED)
        for batch in _slices(batches):
            n, ids, decoded = [], [], []
            for text in batch.column("text").to_pylist():
                found = memory.of(splitter(text or ""))
                joined = " ".join([x for x, _ in found])
                n.append(joined.count(" ") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([x for _, x in found])).hexdigest())
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(digest, f"doc_id {_kind(docs, 'doc_id')}, n_tokens long, ids_sha256 string, decoded_sha256 string")
