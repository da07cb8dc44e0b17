"""Token-id files: documents as ids in ascending order of doc_id, in blocks of the range coder.

Documents are sorted by range of doc_id; each task encodes its range and cuts it into blocks of BLOCK_TOKENS ids, the last one of fewer. A document
goes on in the next block where one is full, so that what a task holds of coded ids is bounded however long a text is. A row of the files is a
block: the part and place of the block, the ids before it in its part, the doc_ids, the ids that earlier blocks hold of each document (0 where it
begins), the ids of each document in this block, and the coded ids. Spark writes the rows as Parquet files, so that a lost task leaves nothing half
written. A document's first id among all is the sum of the parts before (one number for each part) and of what precedes it in its part.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from repograph.llm import rangecoder
from repograph.llm.common import checkpointed, shuffle_partitions

BLOCK_TOKENS = 1 << 12
#: The id that ends each document.
END = 2
#: Pieces whose ids a worker remembers, about; as many again from before. Pieces of more characters are not remembered, so the tables are bounded in bytes.
REMEMBERED, LONGEST_WORD = 300_000, 64
#: Bytes of texts that are taken together, and new pieces that the library gets as one text.
TOGETHER, JOINED = 1 << 23, 128
#: Texts whose ids tell whether a tokenizer's pattern goes over blanks, or takes them into its tokens.
PROBES = ["the quick brown fox", "a  b\n\nc\td ", "It's 12 a-b 3.5\r\n (x y)", "\u00c0\u00c9\u00f1 \u00dfx1.,2((Q)) \u00d7y \u20ac5 n\u0303"]
#: Blanks that the tokenizer turns into a word boundary and that no token spans.
WORD = re.compile("[^ \t\n\r]+")

#: What a tokenizer does before its merges, if words of common characters may be cut and lower-cased here: composed forms, blanks, lower case; then runs of
#: letters, single digits and runs of other characters, each merged by itself.
_KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Kinds of bytes: blanks, letters (ASCII, and U+00C0 to U+00FF but two signs, as UTF-8), digits, other ASCII without apostrophes and controls, and the rest.
_BLANK, _LETTER, _DIGIT, _SIGN, _REST = range(5)


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte, and the byte in lower case."""
    kind, lower = np.full(256, _REST, dtype=np.uint8), np.arange(256, dtype=np.uint8)
    kind[33:127] = _SIGN
    kind[[ord(c) for c in " \t\n\r"]] = _BLANK
    kind[ord("0") : ord("9") + 1] = _DIGIT
    for a, z in ("AZ", "az"):
        kind[ord(a) : ord(z) + 1] = _LETTER
    kind[0x80:0xC0] = kind[0xC3] = _LETTER
    kind[ord("'")] = _REST
    lower[ord("A") : ord("Z") + 1] += 32
    lower[0x80:0x9F] += 32
    return kind, lower


class WordEncoder(dict):
    """Ids of pieces of texts, as little-endian 16-bit numbers, in two generations of bounded size.

    The vocabulary's pattern never goes over a blank, so the ids of a text are those of its words one after another. Where the tokenizer is of the known
    kind, words of ASCII characters and letters up to U+00FF are cut further, as its pattern does, and lower-cased; other words are pieces as they are.
    The library gives the ids of each different piece.
    """

    def __init__(self, vocabulary: str):
        super().__init__()
        # Spark's tasks are the only threads.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        if self.size > 1 << 16:
            raise ValueError(f"a vocabulary of {self.size} ids; files hold ids of 16 bits")
        self.old: dict[str, bytes] = {}
        self.kind, self.lower = _kinds()
        # Matches nothing.
        self.special = re.compile(b"(?!)")
        self.merges = self._merges(vocabulary)
        if self.merges is None:
            self.kind[self.kind != _BLANK] = _REST
        if any(self._of([t])[0] != b"".join(self._of(WORD.findall(t))) or self._of([t]) != self.encode([t]) for t in PROBES):
            raise ValueError("the tokenizer's ids of a text are not those of its words one after another")

    def _merges(self, vocabulary: str) -> Tokenizer | None:
        """The library's tokenizer for pieces that are cut and lower-cased, joined by single blanks; none if the tokenizer is not of the known kind."""
        parts = json.loads(vocabulary)
        model, added = parts["model"], parts.get("added_tokens") or []
        suffix = model.get("end_of_word_suffix")
        if any(parts.get(k) != v for k, v in _KNOWN.items()) or model["type"] != "BPE" or suffix != "</w>" or model.get("dropout"):
            return None
        if parts.get("truncation") or parts.get("padding") or parts.get("post_processor"):
            return None
        if not all({c, c + suffix} <= model["vocab"].keys() for c in ByteLevel.alphabet()):
            return None
        # Special tokens without blanks or capitals are looked for in the words.
        if any(not re.fullmatch(r"<\|[a-z]+\|>", t["content"]) or t["normalized"] for t in added):
            return None
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        plain = parts | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "CharDelimiterSplit", "delimiter": " "}, byte_level]}}
        self.ends = np.zeros(self.size, dtype=bool)
        self.ends[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True
        if added:
            self.special = re.compile(b"|".join(re.escape(t["content"].encode()) for t in added))
        return Tokenizer.from_str(json.dumps(plain))

    def _of(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u2").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _of_plain(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that are cut and lower-cased: the last id of each is one that ends a word."""
        texts = [" ".join(pieces[a : a + JOINED]) for a in range(0, len(pieces), JOINED)]
        ids = np.array([i for e in self.merges.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], dtype="<u2")
        ends = np.flatnonzero(self.ends.take(ids)) + 1
        if len(ends) != len(pieces) or ends[-1] != len(ids):
            raise ValueError("the tokenizer does not end each piece by an id of its own kind")
        raw, ends = ids.tobytes(), (2 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _found(self, pieces: list[str], plain: list[int]) -> list[bytes]:
        """The ids of different pieces."""
        found = list(map(self.get, pieces))
        fresh = [i for i, ids in enumerate(found) if ids is None]
        if self.old:
            for i in fresh:
                found[i] = self.old.get(pieces[i])
            self.update((pieces[i], found[i]) for i in fresh if found[i] is not None)
            fresh = [i for i in fresh if found[i] is None]
        for of, which in ((self._of_plain, [i for i in fresh if plain[i]]), (self._of, [i for i in fresh if not plain[i]])):
            for i, ids in zip(which, of([pieces[i] for i in which]) if which else [], strict=True):
                found[i] = ids
                if len(pieces[i]) <= LONGEST_WORD:
                    self[pieces[i]] = ids
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()
        return found

    def ids(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that are bytes of UTF-8 one after another and begin at these places, and how many ids are before each text and in all."""
        kind = self.kind.take(text)
        lower = self.lower.take(text)
        first = np.zeros(len(text) + 1, dtype=bool)
        first[starts] = True
        first = first[:-1]
        full = kind != _BLANK
        before = np.concatenate([[False], full[:-1]])
        words = np.flatnonzero(full & (first | ~before))
        # Signs of multiplication and division stand among the letters.
        rest = kind == _REST
        rest[1:] |= (text[:-1] == 0xC3) & ((text[1:] & 0xDF) == 0x97)
        # A word with a special token in it is for the whole tokenizer.
        rest[[m.start() for m in self.special.finditer(text)]] = True
        which = np.unique(np.searchsorted(words, np.flatnonzero(rest), side="right") - 1)
        if len(which):
            # The whole word goes as it is.
            ends = np.flatnonzero(full & np.concatenate([first[1:] | ~full[1:], [True]])) + 1
            steps = np.zeros(len(text) + 1, dtype=np.int8)
            steps[words[which]] += 1
            steps[ends[which]] -= 1
            inside = np.cumsum(steps[:-1], dtype=np.int8).astype(bool)
            kind[inside] = _REST
            lower[inside] = text[inside]
        changes = np.empty(len(text), dtype=bool)
        changes[:1] = True
        np.not_equal(kind[1:], kind[:-1], out=changes[1:])
        changes |= first
        changes |= kind == _DIGIT
        changes |= ~before
        changes &= full
        at = np.flatnonzero(changes)
        offsets = np.append(np.flatnonzero(changes[full]), np.count_nonzero(full)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(lower[full])).dictionary_encode()
        of = pieces.indices.to_numpy(zero_copy_only=False)
        # Pieces of the same bytes are of the same kind.
        plain = np.zeros(len(pieces.dictionary), dtype=np.int8)
        plain[of] = kind[at] != _REST
        found = self._found(pieces.dictionary.to_pylist(), plain.tolist())
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) >> 1
        many = sizes.take(of)
        upto = np.cumsum(many)
        shift = (np.cumsum(sizes) - sizes).take(of) - (upto - many)
        total = int(upto[-1]) if len(upto) else 0
        out = np.frombuffer(b"".join(found), dtype="<u2").take(np.repeat(shift, many) + np.arange(total))
        return out, np.append(np.append(0, upto)[np.searchsorted(at, starts)], total)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        raw = [t.encode() for t in texts]
        sizes = np.array([len(t) for t in raw], dtype=np.int64)
        ids, at = self.ids(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum(sizes) - sizes)
        return [ids[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]

    def pieces(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(number of the text, ids, whether the text ends) in the order of the texts, some TOGETHER bytes at a time; longer texts are cut at blanks."""
        raw = texts.fill_null("").cast(pa.large_string())
        raw.validate(full=True)
        if not len(raw):
            return
        ends = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)
        text, at = 0, int(ends[0])
        while text < len(raw):
            # As many whole texts as fit, one at least if it does.
            upto = max(text, int(np.searchsorted(ends, at + TOGETHER, side="right")) - 1)
            if upto > text:
                ids, before = self.ids(data[at : ends[upto]], np.append(at, ends[text + 1 : upto]) - at)
                for i in range(upto - text):
                    yield text + i, ids[before[i] : before[i + 1]], True
                text, at = upto, int(ends[upto])
            else:
                end, to = int(ends[text + 1]), at + TOGETHER
                blank = np.flatnonzero(self.kind.take(data[at:to]) == _BLANK)
                while not len(blank) and to < end:
                    blank = np.flatnonzero(self.kind.take(data[to : min(to + TOGETHER, end)]) == _BLANK) + to - at
                    to += TOGETHER
                cut = at + int(blank[-1]) + 1 if len(blank) else end
                yield text, self.ids(data[at:cut], np.zeros(1, dtype=np.int64))[0], cut == end
                text, at = text + (cut == end), cut


def _worker(vocabulary: str) -> WordEncoder:
    """The encoder that a Python worker keeps from task to task."""
    if _KEPT.get("for") != vocabulary:
        _KEPT.clear()
        _KEPT.update({"for": vocabulary, "encoder": WordEncoder(vocabulary)})
    return _KEPT["encoder"]


_KEPT: dict = {}


def _vocabulary(spark: SparkSession, path: str | None):
    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        # One file of a fixed size, under 2 MB.
        return spark.sparkContext.broadcast(f.read())


def encoded_blocks(docs: DataFrame, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """The rows of the files for docs(doc_id, text): part, block, before, doc_ids, skipped, lengths and coded ids.

    A null text has only the end id. Rows with the same doc_id follow one another in the order of a hash of the text; null doc_ids come first.
    """
    vocabulary = _vocabulary(docs.sparkSession, tokenizer)

    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("skipped", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("coded", pa.binary())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _worker(vocabulary.value), TaskContext.get().partitionId()
        ready: list[tuple[list, list[int], list[np.ndarray], int]] = []
        names, skipped, ids, held, before, block = [], [], [], 0, 0, 0
        stop = np.array([end], dtype="<u2")

        def rows() -> pa.RecordBatch:
            nonlocal block
            coded = rangecoder.encode([np.concatenate(d) for _, _, d, _ in ready], encoder.size)
            n = len(ready)
            out = {"part": [part] * n, "block": range(block, block + n), "before": [b for *_, b in ready], "doc_ids": [n for n, *_ in ready], "skipped": [s for _, s, _, _ in ready], "lengths": [[len(x) for x in d] for _, _, d, _ in ready], "coded": coded}
            block += n
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

        for batch in batches:
            doc_ids, done = batch.column("doc_id").to_pylist(), 0
            for i, tokens, ends in encoder.pieces(batch.column("text")):
                tokens, at = np.concatenate([tokens, stop]) if ends else tokens, 0
                while at < len(tokens):
                    piece = tokens[at : at + BLOCK_TOKENS - held]
                    names.append(doc_ids[i])
                    skipped.append(done + at)
                    ids.append(piece)
                    at, held = at + len(piece), held + len(piece)
                    if held >= BLOCK_TOKENS:
                        ready.append((names, skipped, ids, before))
                        before, names, skipped, ids, held = before + held, [], [], [], 0
                        if len(ready) >= rangecoder.LANES:
                            yield rows()
                done = 0 if ends else done + len(tokens)
        if names:
            ready.append((names, skipped, ids, before))
        if ready:
            yield rows()

    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash")).repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id", "_hash").sortWithinPartitions("doc_id", "_hash")
    return ordered.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "part int, block long, before long, doc_ids array<long>, skipped array<long>, lengths array<int>, coded binary")


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END) -> None:
    """Write the ids of docs(doc_id, text), each document ended by ``end``, in ascending order of doc_id as blocks in Parquet files below path.

    doc_id is a whole number of any type, or null (first); rows with the same one are in the order of their texts' hashes, repeated rows one after another. A null or
    empty text has the end id alone. ``tokenizer`` is a vocabulary of at most 65,536 ids whose tokens don't go over blanks; others raise a ValueError.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be a whole number")
    encoded_blocks(docs, tokenizer, end).write.parquet(path)


def joined_crc32(crcs: list[int], sizes: list[int]) -> int:
    """The CRC-32 of pieces of so many bytes, one after another, from those of the pieces."""
    out = 0
    for crc, size in zip(crcs, sizes, strict=True):
        # What a piece adds does not depend on where it starts from, so it is taken from the checksum of as many zeros.
        zeros = bytes(size)
        out = zlib.crc32(zeros, out) ^ zlib.crc32(zeros) ^ crc
    return out


@F.pandas_udf(T.LongType())
def _joined(crcs: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else joined_crc32([int(x) for x in c], [4 * int(x) for x in n]) for c, n in zip(crcs, sizes, strict=True)], dtype="Int64")


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document of the files; also ``ids`` if wanted.

    The checksum is that of the ids as little-endian unsigned 32-bit numbers. A damaged block raises an error.
    """
    files = spark.read.parquet(path)

    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("skipped", pa.int64()), ("n", pa.int64()), ("crc", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, rangecoder.LANES):
                some = batch.slice(a, rangecoder.LANES).to_pylist()
                rows: list[tuple] = []
                for row, ids in zip(some, rangecoder.decode([r["coded"] for r in some]), strict=True):
                    at = 0
                    for name, skipped, n in zip(row["doc_ids"], row["skipped"], row["lengths"], strict=True):
                        own = ids[at : at + n].astype("<u4")
                        rows.append((row["part"], name, row["before"] + at - skipped, skipped, n, zlib.crc32(own), own))
                        at += n
                yield pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows, strict=True), schema, strict=False)], schema=schema)

    blocks = files.select("part", "before", "doc_ids", "skipped", "lengths", "coded")
    found = blocks.mapInArrow(each, "part int, doc_id long, at long, skipped long, n long, crc long" + ", ids array<long>" * with_ids)
    # A document is told by where it begins; its pieces, of a block at most, are put in order.
    pieces = F.sort_array(F.collect_list(F.struct("skipped", "n", "crc", *["ids"] * with_ids))).alias("_pieces")
    found = found.groupBy("part", "at").agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), pieces)
    several = F.when(F.size("_pieces") > 1, F.col("_pieces"))
    crc = F.coalesce(_joined(several["crc"], several["n"]), F.col("_pieces")[0]["crc"])
    found = found.select("part", "at", "doc_id", "n_tokens", crc.alias("ids_crc32"), *[F.flatten("_pieces.ids").alias("ids")] * with_ids)
    sizes = files.select("part", (F.col("before") + F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)).alias("upto")).groupBy("part").agg(F.max("upto").alias("size"))
    # One row for each part, so its size is bounded by the number of partitions.
    offsets = checkpointed(sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("offset")))
    placed = found.join(F.broadcast(offsets), "part")
    return placed.select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
