"""Document fingerprints from statistically improbable features.

A feature is a window of 64 bytes. Each window has an entropy; how often each entropy occurs is counted over all windows of all documents, and a
window ranks by how rare its entropy is. Of every 64 windows that follow one another the rarest (leftmost of equals) wins; a window that wins 16
times or more is a feature of its text. Features go into a chain of Bloom filters of 2048 bits, 160 to a filter, five bits each. Two fingerprints
are compared filter by filter: bits in common beyond what chance gives, as a part of the most that could be, the best match of each filter of the
shorter chain, on average.

The next document of each is found by one range partitioning of the texts; what lies at the edges of the partitions meets in a second step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.llm.common import shuffle_partitions, written
from repograph.llm.hashing import byte_sums, stretches

#: Bytes of a window, windows that compete, and wins that make a feature.
WINDOW, RIVALS, WINS = 64, 64, 16
#: Entropies are told apart in so many steps; windows below the least say too little (runs of few different bytes).
STEPS, LEAST = 1000, 100
#: Bytes and features of a filter, and bits of a feature.
FILTER, FEATURES, BITS = 256, 160, 5
#: Part of the way from chance to the most that counts for nothing.
CHANCE = 0.3
#: Bytes worked on at a time, about, so that they stay in the cache; a longer text is taken alone.
CHUNK = 1 << 18

_UNIT = 1 << 16
_WEIGHT = np.array([0, *(round(c * np.log2(c) * _UNIT) for c in range(1, WINDOW + 1))], dtype=np.int64)
_RISE = _WEIGHT[1:] - _WEIGHT[:-1]
_MOST = int(np.log2(WINDOW)) * WINDOW * _UNIT


def entropies(raw: np.ndarray) -> np.ndarray:
    """The step (0 to STEPS) of the entropy of each window of raw bytes, in whole numbers."""
    n = len(raw)
    if n < WINDOW:
        return np.zeros(0, dtype=np.int16)
    # How often a byte stands among the 63 before it, and among the 63 after it.
    before, after = np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.uint8)
    for lag in range(1, WINDOW):
        same = (raw[lag:] == raw[:-lag]).view(np.uint8)
        before[lag:] += same
        after[:-lag] += same
    change = _RISE[before]
    change[WINDOW:] -= _RISE[after[: n - WINDOW]]
    total = np.cumsum(change)[WINDOW - 1 :]
    return ((_MOST - total) * STEPS // _MOST).astype(np.int16)


def _chunks(pieces: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, piece in enumerate(pieces):
        if size and size + len(piece) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(piece)
    if start < len(pieces):
        yield start, len(pieces)


def _windows(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, where each piece begins, the entropy step of each window and whether it lies in one piece."""
    raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    steps = entropies(raw)
    inside = np.ones(len(steps), dtype=bool)
    for end in first[1:]:
        inside[max(0, end - WINDOW + 1) : end] = False
    return raw, first, steps, inside


def counted(pieces: list[bytes]) -> np.ndarray:
    """How many windows of the pieces have each entropy step."""
    out = np.zeros(STEPS + 1, dtype=np.int64)
    for start, end in _chunks(pieces):
        _, _, steps, inside = _windows(pieces[start:end])
        out += np.bincount(steps[inside], minlength=STEPS + 1)
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """The rank of each entropy step: rarer ones first, smaller ones first among equals; steps below LEAST have none (STEPS + 1)."""
    rank = np.empty(STEPS + 1, dtype=np.int64)
    rank[np.lexsort((np.arange(STEPS + 1), counts))] = np.arange(STEPS + 1)
    rank[:LEAST] = STEPS + 1
    return rank


def selected(pieces: list[bytes], rank: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Where the features of each piece begin, in order, and their hashes."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for start, end in _chunks(pieces):
        raw, first, steps, inside = _windows(pieces[start:end])
        n = len(steps)
        if not n:
            out += [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))] * (end - start)
            continue
        # Windows without a rank lose to all others. The smallest of each RIVALS windows by running minima from both ends of blocks.
        packed = np.full(-(-n // RIVALS) * RIVALS, np.iinfo(np.int64).max, dtype=np.int64)
        packed[:n] = np.where(inside, rank[steps], STEPS + 1) << 32 | np.arange(n)
        table = packed.reshape(-1, RIVALS)
        forward = np.minimum.accumulate(table, axis=1).ravel()
        backward = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        # Contests of a piece have all their windows in it; a piece with fewer windows has one contest less for each that it lacks.
        contest = np.arange(max(0, n - RIVALS + 1))
        whole = np.ones(len(contest), dtype=bool)
        for edge in first[1:]:
            whole[max(0, edge - WINDOW - RIVALS + 2) : edge] = False
        contest = contest[whole]
        winner = np.minimum(backward[contest], forward[contest + RIVALS - 1])
        winner = (winner & 0xFFFFFFFF)[winner >> 32 <= STEPS]
        at = np.flatnonzero(np.bincount(winner, minlength=n) >= WINS)
        sums, down = byte_sums(raw)
        hashes = stretches(sums, down, at, at + WINDOW)
        bounds = np.searchsorted(at, np.r_[first, len(raw)])
        out += [(at[a:b] - f, hashes[a:b]) for a, b, f in zip(bounds[:-1], bounds[1:], first, strict=True)]
    return out


def whole_feature(text: bytes) -> np.ndarray:
    """The one feature of a text of which no window was selected; none for an empty text."""
    return np.frombuffer(hashlib.blake2b(text, digest_size=8).digest(), dtype=np.uint64) if text else np.zeros(0, dtype=np.uint64)


def digest(features: np.ndarray) -> str:
    """The number of different features and the filters in hexadecimal digits; empty for no features."""
    if not len(features):
        return ""
    _, firsts = np.unique(features, return_index=True)
    features = features[np.sort(firsts)]
    filters = np.zeros((-(-len(features) // FEATURES), FILTER * 8), dtype=np.uint8)
    own = np.arange(len(features)) // FEATURES
    for i in range(BITS):
        filters[own, (features >> np.uint64(11 * i) & np.uint64(FILTER * 8 - 1)).astype(np.int64)] = 1
    return f"{len(features)}:{np.packbits(filters, axis=1).tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """How alike two digests are, from 0 to 1: 1 for equal ones, 0 if one alone is empty."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    sides = []
    for text in (a, b):
        n, _, bits = text.partition(":")
        filters = np.frombuffer(bytes.fromhex(bits), dtype=np.uint64).reshape(-1, FILTER // 8)
        held = np.full(len(filters), FEATURES)
        held[-1] = int(n) - FEATURES * (len(filters) - 1)
        sides.append((filters, held))
    # The shorter chain asks; of equally long ones that with fewer features in its last filter, then the smaller text, so that both orders agree.
    (few, own), (many, other) = sorted(sides, key=lambda s: (len(s[0]), s[1][-1], s[0].tobytes()))
    common = np.bitwise_count(few[:, None, :] & many[None, :, :]).sum(axis=2, dtype=np.int64)
    most = np.minimum(np.bitwise_count(few).sum(axis=1, dtype=np.int64)[:, None], np.bitwise_count(many).sum(axis=1, dtype=np.int64)[None, :])
    m, unset = FILTER * 8, 1 - 1 / (FILTER * 8)
    chance = m * (1 - unset ** (BITS * own)[:, None] - unset ** (BITS * other)[None, :] + unset ** (BITS * (own[:, None] + other[None, :])))
    floor = chance + CHANCE * (most - chance)
    score = np.where(most > floor, (common - floor) / np.maximum(most - floor, 1e-9), 0.0)
    return round(float(np.clip(score, 0.0, 1.0).max(axis=1).mean()), 9)


def entropy_counts(docs: DataFrame) -> np.ndarray:
    """How many windows of all texts have each entropy step; each task sends one row a step."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(STEPS + 1, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out += counted([t or b"" for t in batch.column("text").slice(at, 256).cast(pa.binary()).to_pylist()])
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], names=["step", "n"])

    counts = np.zeros(STEPS + 1, dtype=np.int64)
    for row in docs.select("text").mapInArrow(each, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect():
        counts[row["step"]] = row["n"]
    return counts


#: Bytes on either side of a change within which windows may be selected otherwise.
_REACH = WINDOW + RIVALS


def _edited(text: str, following: str) -> tuple[str, int]:
    """A text with its last third of code points replaced by as many of the following one, and the number of bytes before the change."""
    third = len(text) // 3
    kept = text[: len(text) - third]
    return kept + following[:third], len(kept.encode())


def edited_features(own: tuple[np.ndarray, np.ndarray], kept: int, segment: tuple[np.ndarray, np.ndarray], begin: int) -> np.ndarray:
    """Features of an edited text: those of its own text that lie well before the change, then those of the segment of it from ``begin`` on."""
    upto = kept - _REACH
    return np.concatenate([own[1][own[0] < upto], segment[1][segment[0] + begin >= upto]])


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
EDGE = "_part int, _first boolean, _last boolean, _text string"


class _Fingerprints:
    """Fingerprints of texts, and of texts against those that follow them."""

    def __init__(self, counts: np.ndarray):
        self.rank = ranks(counts)

    def own(self, texts: list[str]) -> list[tuple[tuple[np.ndarray, np.ndarray], str]]:
        raw = [t.encode() for t in texts]
        return [(f, digest(f[1] if len(f[1]) else whole_feature(t))) for t, f in zip(raw, selected(raw, self.rank), strict=True)]

    def against(self, texts: list[str], own: list, following: list[str], following_digest: list[str]) -> list[tuple]:
        edited = [_edited(t, f) for t, f in zip(texts, following, strict=True)]
        raw = [e.encode() for e, _ in edited]
        begin = [max(0, kept - 2 * _REACH) for _, kept in edited]
        rows = []
        for text, (features, print_), (_, kept), whole, at, segment, other in zip(texts, own, edited, raw, begin, selected([r[b:] for r, b in zip(raw, begin, strict=True)], self.rank), following_digest, strict=True):
            found = edited_features(features, kept, segment, at)
            changed = digest(found if len(found) else whole_feature(whole))
            rows.append((len(text), hashlib.sha256(whole).hexdigest(), print_, changed, likeness(print_, changed), likeness(print_, other)))
        return rows


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row of docs(doc_id, text).

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all) of the next document by descending doc_id, null
    last; the first follows the last. Rows with the same doc_id follow one another by hash and text; repeated rows are documents of their own. A null
    text is empty. A text without a selected window (all texts under 127 bytes) is one feature as a whole; an empty one has the empty fingerprint, which is
    like itself alone.
    """
    held = docs.sparkSession.sparkContext.broadcast(_Fingerprints(entropy_counts(docs)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [c.split()[0] for c in f"{RESULT}, {EDGE}".split(", ")]
    types = [pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.int32(), pa.bool_(), pa.bool_(), pa.string()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one partition in order. The last row waits for the first of the next partition, and both carry their texts."""
        last = part = None
        first = True

        def made(ids: pa.Array, texts: list[str], own: list, following: list[str], digests: list[str]) -> pa.RecordBatch:
            nonlocal first
            rows = [(*r, part, False, False, None) for r in held.value.against(texts, own, following, digests)]
            if first and rows:
                rows[0], first = (*rows[0][:7], True, False, texts[0]), False
            return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=["doc_id", *names])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                part = some.column("_part")[0].as_py()
                ids, texts = some.column("doc_id"), [t or "" for t in some.column("text").to_pylist()]
                own = held.value.own(texts)
                if last is not None:
                    ids, texts, own = pa.concat_arrays([last[0], ids]), [last[1], *texts], [last[2], *own]
                if len(texts) > 1:
                    yield made(ids.slice(0, len(texts) - 1), texts[:-1], own[:-1], texts[1:], [d for _, d in own[1:]])
                last = ids.slice(len(texts) - 1), texts[-1], own[-1]
        if last is not None:
            row = (len(last[1]), None, last[2][1], None, None, None, part, first, True, last[1])
            yield pa.RecordBatch.from_arrays([last[0], *(pa.array([x], t) for x, t in zip(row, types, strict=True))], names=["doc_id", *names])

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = [batch.column(c).to_pylist() for c in ("_text", "_next", "_digest")]
                rows = held.value.against(texts[0], held.value.own(texts[0]), texts[1], texts[2])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False))], names=["doc_id", *names[:6]])

    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(shuffle_partitions(docs.sparkSession), *order[:2])
    placed = texts.sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("_part"))
    done, _ = written(placed.mapInArrow(each, f"doc_id {kind}, {RESULT}, {EDGE}"), "fingerprints")
    # Two rows for each partition.
    edges = done.where("_first or _last")
    parts = sorted(r["_part"] for r in edges.where("_first").select("_part").collect())
    following = docs.sparkSession.createDataFrame([*zip(parts, [*parts[1:], *parts[:1]], strict=True)], "_part int, _to int")
    heads = edges.where("_first").select(F.col("_part").alias("_to"), F.col("_text").alias("_next"), F.col("fingerprint").alias("_digest"))
    tails = edges.where("_last").join(F.broadcast(following), "_part").join(heads, "_to").select("doc_id", "_text", "_next", "_digest")
    return done.where("not _last").select("doc_id", *names[:6]).unionByName(tails.mapInArrow(closed, f"doc_id {kind}, {RESULT}"))
