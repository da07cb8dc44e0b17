"""The operators over small tables with nulls, empty and long texts, ties, repeated rows, no rows and extra columns."""

import hashlib
import json
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from repograph.llm import bpe, chat, components, hamming, jaccard, mixing, quality, sharding, suffixes, tokenfiles, urls
from repograph.llm.queries import URL_RULES, op6_token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int"
LONG = "lorem ipsum dolor sit amet " * 3000
PASSAGE = " ".join(f"w{i}" for i in range(70))
TEXTS = ["", None, "a b c", "A b C", " \t\n", LONG, f"x {PASSAGE} y", f"other start {PASSAGE} other end", " ".join(f"q{i}" for i in range(40)), " ".join(f"q{i}" for i in range(40)) + " tail", "é ü 中文 🙂"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", 0, 9, 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[2], rows[6]], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_mixing(docs, nothing):
    out = rows_of(mixing.mix_sources(docs))
    assert len(out) == 13 and all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    by_source = {r["source"]: r for r in out}
    for source, r in by_source.items():
        assert r["target"] <= 3 * r["source_size"]
        assert abs(sum(x["taken"] for x in out if x["source"] == source) - r["target"]) <= max(3, 0.01 * r["target"])
    assert sum(r["target"] for r in by_source.values()) == pytest.approx(sum(r["size"] for r in out))
    assert sorted(map(str, out)) == sorted(map(str, rows_of(mixing.mix_sources(docs.repartition(3)))))
    assert rows_of(mixing.mix_sources(nothing)) == []
    assert mixing.mix_documents(docs).columns == docs.columns


def test_suffix_dedup(docs, nothing):
    length = 200
    out = rows_of(suffixes.dedup_digest(docs, length))
    raw = [(t or "").encode() for t in [*TEXTS, TEXTS[2], TEXTS[6]]]
    count = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    expected = Counter()
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        expected[len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    assert Counter((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == expected
    assert rows_of(suffixes.dedup_digest(nothing)) == []
    left = suffixes.remove_repeats(docs, length)
    assert left.columns == docs.columns and left.count() == 13


def removed_bytes(texts, length=200):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    gone = [bytearray(len(t)) for t in texts]
    for t, g in zip(texts, gone, strict=True):
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                g[i : i + length] = b"\1" * length
    return [sum(g) for g in gone]


def test_suffix_dedup_of_an_anchor_with_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "ANCHOR_LIMIT", 2)
    texts = [f"{i * 7919} before {PASSAGE[: 210 + 3 * i]} after {i * 104729} {'x' * (180 + i)}" for i in range(24)]
    texts += texts[3:5]
    out = rows_of(suffixes.dedup_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [r["n_removed"] for r in sorted(out, key=lambda r: r["doc_id"])] == removed_bytes([t.encode() for t in texts])


def test_suffix_dedup_of_texts_made_to_share_hashes(spark):
    # Sums modulo 2**64 of the first two agree, and so do all XXH64 hashes of the next two with their doc_id.
    x, y = ("".join(("fsfkonqe", "zhpkhhsb")[(i.bit_count() + k) % 2] for i in range(16)) for k in (0, 1))
    head = "898001 293271 635247 703881 729353 171022 732551 902443 342245 568082 94"
    body = "-" * 24 + " ".join(f"w{i}" for i in range(70))
    one, other = '0123456"' + "-" * 24 + "!!!(DA!!" + body, "0123456$" + "-" * 24 + "!!!!!!2+" + body
    rows = [(0, head + x), (1, head + y), (2, one), (2, other), (3, one)]
    out = Counter((r["doc_id"], r["n_removed"]) for r in rows_of(suffixes.dedup_digest(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))))
    assert out == Counter(zip((i for i, _ in rows), removed_bytes([t.encode() for _, t in rows]), strict=True))
    assert out == Counter([(0, 0), (1, 0), (2, len(one)), (2, len(body)), (3, len(one))])


def test_suffix_dedup_keeps_ids_and_columns(spark):
    large = (1 << 60) + 1
    rows = [(large, PASSAGE, 1, 2, "x"), (None, f"other {PASSAGE}", 3, 4, None), (None, None, 5, 6, ""), (large, PASSAGE, 1, 2, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc int, _doc int, anchor string").coalesce(1)
    out = Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in rows_of(suffixes.dedup_digest(docs)))
    n = len(PASSAGE)
    assert out == Counter([(large, n, n), (large, n, n), (None, n + 6, n), (None, 0, 0)])
    left = suffixes.remove_repeats(docs)
    assert left.columns == docs.columns and Counter(map(tuple, left.collect())) == Counter([(large, "", 1, 2, "x"), (None, "other ", 3, 4, None), (None, None, 5, 6, ""), (large, "", 1, 2, "x")])


def test_url_filters(spark):
    pages = [
        (0, "http://A.Example.COM/en/5?x", None), (1, "http://a.example.com/en/77", ""), (2, "https://x.net/de/8", ""), (3, "https://www.example.net/de/85#t", ""), (4, None, "<a href='//bad.org/'>"), (5, "no url", None),
        (6, "http://bad.org/es/1", ""), (7, "http://bad.org/fr/1", '<a href="http://spam.biz/x">'), (8, "http://spam.biz/", '<a href="http://bad.org/">'), (9, "http://netx/de/", ""), (9, "http://netx/de/", ""),
    ]
    out = rows_of(urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES))
    assert len(out) == 11
    by_id = {r["page_id"]: r for r in out}
    assert (by_id[0]["host"], by_id[0]["path"], by_id[0]["rule"], by_id[0]["verdict"]) == ("a.example.com", "/en/5", "com/en/", "block")
    assert [by_id[i]["rule"] for i in (1, 2, 3, 6, 9)] == ["example.com/en/7", "net/de/", "example.net/de/8", "org/es/", None]
    assert (by_id[4]["host"], by_id[4]["path"], by_id[5]["verdict"]) == ("", "", "allow")
    assert by_id[8]["verdict"] == "block" and by_id[9]["verdict"] == "allow"
    assert rows_of(urls.filter_urls(spark.createDataFrame([], "page_id long, url string, html string"), URL_RULES)) == []


def _linking(links):
    """A page for each host of links, on a path that no rule fits."""
    return [(i, f"http://{src}/x", "".join(f'<a href="http://{dst}/">' for dst in dsts)) for i, (src, dsts) in enumerate(links.items())]


def test_url_filters_far_and_small_distrust(spark):
    # Distrust goes against the links: to a host 12 links away, and to one that gets 0.0085**5 * 0.15 of it at five links of a hundred each.
    far = {f"f{k}.biz": [f"f{k - 1}.biz" if k > 1 else "bad.org"] for k in range(1, 13)}
    small = {f"s{k}x{i}.biz": [f"s{k - 1}x0.biz" if k > 1 else "worse.org"] for k in range(1, 6) for i in range(100)}
    pages = [*_linking(far | small), (1000, "http://bad.org/es/1", ""), (1001, "http://worse.org/es/1", "")]
    out = {r["host"]: r for r in rows_of(urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES))}
    assert all(out[h]["verdict"] == "block" for h in far | small)
    assert out["f12.biz"]["distrust"] == pytest.approx(0.5 * 0.15 * 0.85**12) and out["s5x7.biz"]["distrust"] == pytest.approx(0.5 * 0.15 * 0.0085**5)


def test_url_filters_equal_the_solved_ranks(spark):
    names = [f"h{i}.biz" for i in range(12)] + ["good.net", "bad.org"]
    links = {h: [names[(i * 5 + k * k + 1) % 14] for k in range(1 + i % 3)] for i, h in enumerate(names)}
    pages = [*_linking(links), (100, "http://good.net/de/1", ""), (101, "http://bad.org/es/1", "")]
    weight = np.zeros((14, 14))
    for h, to in links.items():
        for d in to:
            if d != h:
                weight[names.index(h), names.index(d)] += 1
    shares = lambda w: w / np.where(w.sum(1) > 0, w.sum(1), 1)[:, None]
    solved = lambda w, seed: np.linalg.solve(np.eye(14) - 0.85 * shares(w).T, 0.15 * np.eye(14)[seed])
    trust, distrust = solved(weight, 12), solved(weight.T, 13)
    out = rows_of(urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES))
    for r in out:
        i = names.index(r["host"])
        assert r["trust"] == pytest.approx(trust[i], rel=1e-5) and r["distrust"] == pytest.approx(distrust[i], rel=1e-5)
        if r["rule"] is None:
            assert r["verdict"] == ("block" if distrust[i] > trust[i] * 1.000001 else "allow")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_near_duplicates(spark, docs, nothing, width, percent):
    base = [f"t{i}" for i in range(60)]
    more = [" ".join(base[:k] + [f"n{k}"] + base[k:]) for k in range(0, 60, 4)] + [" ".join(base[:40] + base[45:])]
    every = docs.unionByName(spark.createDataFrame([(100 + i, t, "en", "s", 0, 0, 0) for i, t in enumerate(more)], SCHEMA))
    rows = [(r.doc_id, words_of(r.text)) for r in every.collect()]
    sets = [(i, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())) for i, w in rows]
    group = {i: i for i, _ in sets}
    for _ in range(len(sets)):
        for i, a in sets:
            for j, b in sets:
                if a and 100 * len(a & b) >= percent * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    out = rows_of(jaccard.near_duplicates(every, width, percent))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == sorted((i, len(s), group[i]) for i, s in sets)
    kept = jaccard.keep_one(every, width, percent)
    assert kept.columns == docs.columns
    assert sorted({r.doc_id for r in kept.collect()}) == sorted({i for i, _ in sets if group[i] == i})
    assert rows_of(jaccard.near_duplicates(nothing)) == []


def test_near_duplicates_with_null_and_repeated_ids(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    near = lambda c: text(c) + " tail"
    rows = [(None, text("a")), (None, text("b")), (None, near("b")), (7, text("c")), (7, text("d")), (8, near("c")), (8, text("e")), (9, text("e")), (9, near("d")), (None, near("e")), (None, ""), (None, ""), (7, None), (10, text("f")), (10, text("f"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter((r["doc_id"], r["component_id"]) for r in rows_of(jaccard.near_duplicates(docs)))
    assert found == Counter({(None, None): 5, (7, 7): 3, (8, 7): 1, (8, 8): 1, (9, 8): 1, (9, 7): 1, (None, 8): 1, (10, 10): 2})
    kept = Counter((r["doc_id"], r["text"]) for r in rows_of(jaccard.keep_one(docs)))
    of_b = [x for x in kept if x[1] in (text("b"), near("b"))]
    assert len(of_b) == 1 and of_b[0][0] is None
    assert kept - Counter(of_b) == Counter([rows[0], rows[3], rows[4], rows[6], (None, ""), (None, ""), (7, None), rows[13]])


def test_tiles_of_classes_with_the_same_short_hash(spark):
    same = spark.range(400_000).select(F.xxhash64("id").alias("c")).groupBy(F.hash("c")).agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").first()
    tiles = spark.createDataFrame([(same.a, 1), (same.b, 1), (same.a, 2), (same.a, 2)], "class long, tile long")
    assert [r.tile for r in jaccard.tiles_of_several(tiles).collect()] == [1]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (40, 60), (7, 7)], "a long, b long")
    found = {r["node"]: r["component"] for r in rows_of(components.connected_components(links))}
    assert all(found[i] == 0 for i in range(21)) and found[60] == found[50] == found[40] == 40


def test_quality(spark, docs, nothing):
    good = [(i, " ".join(f"word{(i * 31 + k * 17) % 997}" for k in range(80)), 1) for i in range(60)]
    bad = [(100 + i, " ".join(f"w{(i * 13 + k) % 499}###" for k in range(80)), 0) for i in range(60)]
    made = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(None, 1), (5, None)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in rows_of(quality.judge(made, labels))}
    assert all(out[i]["kept"] for i in range(60)) and not any(out[100 + i]["kept"] for i in range(60))
    assert quality.keep_good(made, labels).count() == 60
    judged = rows_of(quality.judge(docs, labels.limit(0)))
    assert len(judged) == 13 and quality.judge(nothing, labels).count() == 0
    for r in judged:
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        seen, places = Counter(zip(w, w[1:], w[2:], strict=False)), set()
        for k in range(len(w) - 2):
            if seen[tuple(w[k : k + 3])] > 1:
                places |= {k, k + 1, k + 2}
        lines = [line for line in (r["text"] or "").split("\n") if words_of(line)]
        assert (r["n_symbols"], r["n_dup_lines"]) == (len(re.findall(r"[#*$%&|<>]", r["text"] or "")), len(lines) - len(set(lines)))
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), len(places), len(w) < 50 or 2 * len(places) > len(w))


def test_token_files(spark, docs, nothing, tmp_path):
    tokenfiles.write_token_files(docs, str(tmp_path / "a"))
    out = sorted(rows_of(tokenfiles.read_documents(spark, str(tmp_path / "a"))), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == sorted(r["doc_id"] for r in out) and len(out) == 13
    at = 0
    for r in out:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = {r["doc_id"]: r["ids"] for r in rows_of(tokenfiles.read_documents(spark, str(tmp_path / "a"), with_ids=True))}
    assert ids[0] == ids[1] == [2] and len(ids[5]) > 3000
    tokenfiles.write_token_files(nothing, str(tmp_path / "b"))
    assert rows_of(tokenfiles.read_documents(spark, str(tmp_path / "b"))) == []


def test_token_files_split_long_documents(spark, tmp_path):
    n = tokenfiles.BLOCK_TOKENS
    texts = [(None, "alpha beta"), (0, "lorem ipsum dolor " * n), (1, ""), (2, None), (3, "a b c"), (3, "one two three " * (n // 2))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    path = str(tmp_path / "long")
    tokenfiles.write_token_files(docs, path)
    blocks = spark.read.parquet(path).collect()
    assert max(sum(b.lengths) for b in blocks) <= n and len(blocks) > 3
    out = sorted(rows_of(tokenfiles.read_documents(spark, path, with_ids=True)), key=lambda r: r["start"])
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = tokenfiles.WordEncoder(f.read())
    whole = Counter((i, (*np.frombuffer(encoder.encode([t or ""])[0], dtype="<u2").tolist(), 2)) for i, t in texts)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in out) == whole and [r["doc_id"] for r in out] == [None, 0, 1, 2, 3, 3]
    at = 0
    for r in out:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"])) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        at += r["n_tokens"]


def test_token_file_query_equals_the_library_on_whole_texts(spark):
    """Ids of the tokenizers library for each whole document, not for words, and their checksums."""
    folder = "/root/testdata/sf0.001"
    library, at, expected = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, {}
    for r in sorted(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        expected[r.doc_id] = (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows_of(op6_token_files(spark, folder))} == expected


def test_token_files_of_names_that_are_no_numbers(spark, tmp_path):
    with pytest.raises(TypeError):
        tokenfiles.write_token_files(spark.createDataFrame([("a", "b")], "doc_id string, text string"), str(tmp_path / "x"))


def test_labels_beyond_the_bound_are_chosen_by_their_hash(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    some = [r["doc_id"] for r in rows_of(quality.labelled_statistics(docs, labels, 300))]
    first = labels.orderBy(F.xxhash64("doc_id")).limit(300).select("doc_id")
    assert len(some) == 300 and set(some) == {r["doc_id"] for r in rows_of(first)}


def test_sharding(spark, docs, nothing):
    out = rows_of(sharding.shard_documents(docs, 4))
    shards = Counter(r["shard"] for r in out)
    assert sorted(shards.values()) == [3, 3, 3, 4]
    for s in shards:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(shards[s]))
    assert sorted(map(str, out)) == sorted(map(str, rows_of(sharding.shard_documents(docs.repartition(3), 4))))
    assert rows_of(sharding.shard_documents(nothing)) == []
    assert {"text", "lang"} <= set(sharding.shard_rows(docs, 4, ["doc_id"]).columns)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutation(spark, n):
    placed = spark.range(n).withColumn("p", sharding.permute(F.col("id"), n, 9))
    placed = placed.withColumn("back", sharding.permute(F.col("p"), n, 9, inverse=True)).collect()
    assert sorted(r.p for r in placed) == list(range(n)) and all(r.id == r.back for r in placed)


def test_top_k(spark):
    rows = [(i, [float((i * 7 + k * 5) % 11 - 5) for k in range(64)]) for i in range(45)] + [(45, None), (None, [1.0] * 64), (46, [1.0]), (47, [float("nan")] * 64)]
    out = rows_of(hamming.nearest_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5))
    code = lambda v: [k < len(v) and v[k] == v[k] and v[k] > 0 for k in range(64)]
    known = {i: code(v) for i, v in rows if i is not None and v is not None}
    for q in (0, 20, 40):
        expected = sorted((sum(x != y for x, y in zip(known[q], c, strict=True)), i) for i, c in known.items())[:5]
        assert [(r["distance"], r["id"]) for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q] == expected
    assert rows_of(hamming.nearest_embeddings(spark.createDataFrame([], "vec_id long, embedding array<double>"))) == []


def test_preferences(spark):
    turns = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "good <|end|>"), (1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (1, 1, "assistant", "bad"),
        (2, 0, None, None), (3, 0, None, None), (4, 0, "user", "alone"), (None, 0, "user", "x"),
    ]
    out = {r["pair_id"]: r for r in rows_of(chat.format_preferences(chat.neighbouring_pairs(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))))}
    assert out[0]["prompt"] == "<|user|>\nhi<|end|>\n" and out[0]["n_prompt_turns"] == 1
    start, end = map(int, out[0]["chosen_spans"].split("-"))
    assert out[0]["chosen"][start:end] == "good < |end|><|end|>"
    assert out[0]["rejected"].count("bad") == 2 and len(out[0]["rejected_spans"].split()) == 2
    assert out[1]["n_prompt_turns"] == 1 and out[1]["chosen"] == out[1]["rejected"] == ""
    assert out[2]["prompt"] == "" and out[2]["rejected"] == "" and set(out) == {0, 1, 2}


def test_answer_pairs(spark):
    schema = "conv_id long, turn long, role string, text string, pair_id string"
    top = (1 << 63) - 1
    turns = [
        (0, 0, "user", "hi", "x"), (0, 1, "assistant", "a", "x"), (0, 2, "user", "more", "x"), (0, 3, "assistant", "b", "x"), (0, 4, "user", "bye", "x"),
        (1, 0, "user", "hi", None), (1, 1, "assistant", "other", None), (2, 0, "user", "only", "x"), (2, 0, "user", "only", "x"), (3, None, "assistant", None, "x"),
        (3, 1, None, LONG, "x"), (5, 0, "assistant", "last", "x"), (top, 0, "assistant", "end", "x"), (None, 0, "assistant", "lost", "x"),
    ]
    out = {r["pair_id"]: r for r in rows_of(chat.format_preferences(chat.answer_pairs(spark.createDataFrame(turns, schema))))}
    shown = lambda *pairs: "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in pairs)
    expected = {
        0: ([("user", "hi"), ("assistant", "a"), ("user", "more")], [("assistant", "b"), ("user", "bye")], [("assistant", "other")]),
        1: ([("user", "hi")], [("assistant", "other")], [("assistant", "b")]),
        2: ([("user", "only")] * 2, [], [("assistant", "")]),
        3: ([], [("assistant", ""), ("unknown", LONG)], []),
        5: ([], [("assistant", "last")], []),
        top: ([], [("assistant", "end")], []),
    }
    assert set(out) == set(expected)
    for i, (prompt, chosen, rejected) in expected.items():
        r = out[i]
        assert (r["n_prompt_turns"], r["prompt"], r["chosen"], r["rejected"]) == (len(prompt), shown(*prompt), shown(*chosen), shown(*rejected))
        for side, said in (("chosen", chosen), ("rejected", rejected)):
            spans = [tuple(map(int, s.split("-"))) for s in r[f"{side}_spans"].split()]
            assert [r[side][a:b] for a, b in spans] == [f"{text}<|end|>" for role, text in said if role == "assistant"]
    assert rows_of(chat.format_preferences(chat.answer_pairs(spark.createDataFrame([], schema)))) == []


def test_bpe(docs, nothing):
    ids = {r["doc_id"]: r["ids"] for r in rows_of(bpe.encode_documents(docs))}
    decoded = {r["doc_id"]: bytes(r["decoded"]).decode() for r in rows_of(bpe.decode_documents(bpe.encode_documents(docs)))}
    for r in rows_of(bpe.round_trip(docs)):
        i = r["doc_id"]
        assert r["n_tokens"] == len(ids[i]) and decoded[i] == (TEXTS[i] or "")
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids[i])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((TEXTS[i] or "").encode()).hexdigest()
    assert rows_of(bpe.round_trip(nothing)) == [] and json.dumps(ids[0]) == "[]"


def test_bpe_keeps_large_and_null_ids(spark):
    large = (1 << 60) + 1
    docs = spark.createDataFrame([(large, "some text"), (None, "other"), (None, None)], "doc_id long, text string").coalesce(1)
    for made in (bpe.round_trip(docs), bpe.encode_documents(docs), bpe.decode_documents(bpe.encode_documents(docs))):
        assert Counter(r["doc_id"] for r in rows_of(made)) == Counter([large, None, None])
    named = bpe.encode_documents(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit("x").alias("ids"), F.array(F.lit(1)).alias("_n")))
    assert {r["doc_id"] for r in rows_of(named)} == {str(large), None} and named.columns == ["doc_id", "text", "_n", "ids"]


def test_compared_pairs_equal_all_pairs(monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(jaccard, "LARGE", 9)
    rows = []
    for tile, size in enumerate((2, 3, 8, 9, 14, 30)):
        base = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
        for k in range(size):
            s = np.delete(base, rng.integers(0, len(base), rng.integers(0, 60)))
            s = s[: rng.choice([len(s), 40])]
            rows.append((tile, 100 * tile + k, int(rng.integers(0, 4)), len(s), int(rng.integers(0, 2)), jaccard.parity_bitmap(s, 80)))
    tile, name, component, n, side, bitmap = zip(*rows, strict=True)
    compared = jaccard.Compared(*(np.array(x) for x in (tile, name, component, n, side)), list(bitmap), 80)
    expected = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            one_block = len({r[4] for r in rows if r[0] == a[0]}) == 1
            if a[0] == b[0] and a[2] != b[2] and (one_block or a[4] != b[4]):
                d = jaccard.bound_on_difference(*jaccard._folded([a[5], b[5]]))
                if 100 * min(a[3], b[3]) >= 80 * max(a[3], b[3]) and 100 * (a[3] + b[3] - d) >= 80 * (a[3] + b[3] + d):
                    expected.add((a[1], b[1]))
    # Bitmaps of a large tile are folded to its shortest, so that more pairs may pass, but none is lost.
    found = set(map(tuple, compared.pairs(False).tolist()))
    assert expected <= found and {p for p in found if p[0] < 300} == {p for p in expected if p[0] < 300}
    assert {x for p in compared.pairs(True).tolist() for x in p} == {x for p in found for x in p}


def test_names_of_classes_that_share_a_half():
    a, b = np.array([1, 2, 3], dtype=np.uint64), np.array([1, 2, 4], dtype=np.uint64)
    first, second = jaccard.fingerprint(a)
    assert jaccard.fingerprint(a, frozenset([first])) != (first, second) and jaccard.fingerprint(a, frozenset([first]))[1] == second
    assert jaccard.fingerprint(b, frozenset([first])) == jaccard.fingerprint(b)


def test_keep_one_with_any_columns(spark):
    text = " ".join(f"a{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, 5, 6), (2, text + " tail", 7, 8), (3, None, 9, 9)], "doc_id long, text string, _n int, _key int")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == [(1, text, 5, 6), (3, None, 9, 9)]


def test_near_duplicates_with_large_ids(spark):
    large = (1 << 60) + 1
    docs = spark.createDataFrame([(large, "a b c d e f"), (None, "a b c d e f"), (large + 2, "z y x")], "doc_id long, text string").coalesce(1)
    assert Counter((r["doc_id"], r["component_id"]) for r in rows_of(jaccard.near_duplicates(docs))) == Counter([(large, large), (None, large), (large + 2, large + 2)])


def test_mixing_equals_the_plain_schedule(spark):
    sizes = {None: 700, "a": 40, "b": 900, "c": 3000, "d": 1}
    docs = spark.createDataFrame([(i, s, "w " * n) for i, (s, n) in enumerate(sizes.items())], "doc_id long, source string, text string")
    out = {r["source"]: r for r in rows_of(mixing.mix_sources(docs))}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, target, left = sum(sizes.values()), {}, set(sizes)
    while True:
        rest = total - sum(target.values())
        full = {s for s in left if rest * weight[s] / sum(weight[x] for x in left) > 3 * sizes[s]}
        if not full:
            break
        target |= {s: 3 * sizes[s] for s in full}
        left -= full
    target |= {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
    # Blocks are of one word here, so a source takes a word for each of its slots, up to three times its own.
    share, edges = 0.0, []
    for s in order:
        edges.append((s, round(share / total * mixing.POINTS), round((share + target[s]) / total * mixing.POINTS)))
        share += target[s]
    slots = Counter(next(s for s, low, high in edges if low <= (i + 1) * mixing.GOLDEN % mixing.POINTS < high) for i in range(total))
    for s in sizes:
        assert out[s]["weight"] == weight[s] and out[s]["target"] == pytest.approx(target[s])
        assert out[s]["taken"] == min(slots[s], 3 * sizes[s]) and abs(slots[s] - target[s]) < mixing.most_apart(total)


def test_small_sources_beside_a_large_one_get_their_targets(spark):
    rows = [(i, "large", 1_000_000) for i in range(80)] + [(1000 + i, f"small{i:03d}", n) for i, n in enumerate([200] * 100 + [3, 20_000, 1])]
    out = rows_of(mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, size long"), F.col("size")))
    taken, target = Counter(), {}
    for r in out:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - t) <= max(3, 0.05 * t) for s, t in target.items()), [(s, taken[s], t) for s, t in target.items() if abs(taken[s] - t) > max(3, 0.05 * t)]


def test_mixed_documents_keep_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 999, 5), (2, "d e", "y", 7, None), (2, None, "y", 7, None)], "doc_id long, text string, source string, _size int, _times int")
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}


def test_quality_of_long_and_repetitive_texts(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, n, m)) for n, m in ((2, 50), (5, 300), (40, 3000), (1000, 20000))] + ["a a a a a", "x y", "x y z x y z", "p q r q r p q"]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, _s int")
    out = {r["doc_id"]: r for r in rows_of(quality.judge(docs, spark.createDataFrame([], "doc_id long, quality int")))}
    for i, t in enumerate(texts):
        w, places = t.split(), set()
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        for k in range(len(w) - 2):
            places |= {k, k + 1, k + 2} if seen[tuple(w[k : k + 3])] > 1 else set()
        assert out[i]["n_repeat_words"] == len(places) and out[i]["_s"] == 5


def test_hosts_under_a_registry_are_not_alike(spark):
    pages = spark.createDataFrame([("a.co.uk", None), ("b.co.uk", ""), ("www.a.co.uk", "")], "host string, html string")
    assert {(r["src"], r["dst"]) for r in rows_of(urls.host_edges(pages))} == {("www.a.co.uk", "a.co.uk"), ("a.co.uk", "www.a.co.uk")}


def test_shards_of_documents_and_files(spark, docs, tmp_path):
    out = rows_of(sharding.shard_documents(docs, 4))
    expected = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in [*enumerate(TEXTS), (2, TEXTS[2]), (6, TEXTS[6])])
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == expected
    rows = spark.range(500).select(F.lit(1).alias("doc_id"), (F.col("id") % 50).alias("x"))
    place = lambda df: Counter((r["x"], r["shard"], r["slot"]) for r in rows_of(sharding.shard_rows(df, 3, ["doc_id"])))
    assert place(rows) == place(rows.orderBy(F.desc("x")).repartition(7))
    sharding.write_shards(sharding.shard_rows(rows, 3, ["doc_id"]), str(tmp_path / "shards"))
    for s in range(3):
        files = sorted((tmp_path / "shards" / f"shard={s}").glob("*.parquet"))
        slots = [r.slot for f in files for r in spark.read.parquet(str(f)).collect()]
        assert slots == list(range(len(slots)))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    good = lambda k: " ".join(f"word{k * 80 + j}" for j in range(80))
    rows = [(i, good(i), "en", f"s{i % 3}", 400, i) for i in range(30)] + [(40, good(3) + " tail", "en", "s0", 400, 1), (41, good(5), "de", None, 400, 1), (41, good(5), "de", None, 400, 1), (42, None, None, None, None, None), (43, "", "en", "s1", 0, 1), (None, good(77), "en", "s1", 400, 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _key int"
    made = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = made
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == made.columns, name
        if name == "quality rules":
            assert Counter(r.doc_id for r in docs.collect()) == Counter([*range(30), 40, 41, 41, None])
        if name == "n-gram Jaccard join":
            assert Counter(r.doc_id for r in docs.collect()) == Counter([*range(30), None])
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert out.count() == docs.count() > 20 and all(r.n_tokens == len(r.ids) for r in out.collect())
    empty = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
    made.write.parquet(str(tmp_path / "documents.parquet"))
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(str, ran.collect())) == Counter(map(str, out.collect()))
