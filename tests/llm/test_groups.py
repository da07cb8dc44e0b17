"""Centroid clusters, improbable features and spelling variants against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from repograph.llm import centroids, improbable, spelling
from repograph.llm import queries as Q

DATA = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, cluster int, label string"
DOCS = "doc_id long, text string, fingerprint int, word string"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def plain_clusters(rows, k, rounds, width):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    heads = [list(v) for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for last in [False] * rounds + [True]:
        own = [min((far(v, c), n) for n, c in enumerate(heads)) for _, v in kept]
        if not last:
            for n in range(len(heads)):
                of = [v for (_, v), (_, c) in zip(kept, own, strict=True) if c == n]
                if of:
                    heads[n] = [sum(x) // len(of) for x in zip(*of, strict=True)]
    inertia = Counter()
    for d, c in own:
        inertia[c] += d
    return Counter((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, heads[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, own, strict=True))


@pytest.mark.parametrize("k", [1, 5, 16, 60])
def test_clusters_equal_a_plain_version(spark, k):
    draw = random.Random(k)
    rows = [(i, [draw.choice([-2.0, -0.51, 0.0, 0.24, 0.25, 3.0]) for _ in range(4)], 7, "x") for i in range(150)]
    rows += [(200, None, 1, "x"), (201, [1.0], 1, "x"), (202, [1.0, None, 1.0, 1.0], 1, "x"), (203, [1.0, float("nan"), 0.0, 0.0], 1, "x"), (204, [float("inf"), 0.0, 0.0, 0.0], 1, "x"), (None, [0.1, 0.2, 0.3, 0.4], 1, "x"), rows[3], rows[3]]
    out = centroids.cluster_vectors(spark.createDataFrame(rows, VECTORS), k=k, width=4)
    assert Counter(tuple(r.values()) for r in rows_of(out)) == plain_clusters([r[:2] for r in rows], k, 3, 4)


def test_clusters_of_nothing_and_few(spark):
    assert rows_of(centroids.cluster_vectors(spark.createDataFrame([], VECTORS))) == []
    one = rows_of(centroids.cluster_vectors(spark.createDataFrame([(5, [1e300] * 64, 0, "")], VECTORS)))
    assert [(r["vec_id"], r["cluster"], r["distance"], r["inertia"]) for r in one] == [(5, 0, 0, 0)]


def test_cluster_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    expected = Counter(con.sql(f"SELECT vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 FROM ({Q.SQL['op11_centroid_clusters']})").fetchall())
    assert Counter(tuple(r) for r in Q.op11_centroid_clusters(spark, DATA).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()) == expected


def test_vantage_tree_passes_over_far_centroids():
    draw = np.random.default_rng(0)
    points = (draw.integers(0, 40, (64, 1)) * 1000 + draw.integers(0, 50, (64, 8))).astype(np.int64)
    vectors = points[draw.integers(0, 64, 500)] + draw.integers(-9, 9, (500, 8))
    tree = centroids.VantageTree.build(points)
    own, distance, measured = tree.nearest(vectors)
    every = ((vectors[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    assert (own == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert measured < 0.5 * every.size


def plain_steps(text):
    out = []
    for i in range(len(text) - 63):
        total = sum(round(c * math.log2(c) * 65536) for c in Counter(text[i : i + 64]).values())
        out.append((6 * 64 * 65536 - total) * 1000 // (6 * 64 * 65536))
    return out


def plain_features(text, rank):
    steps = plain_steps(text)
    wins = Counter()
    for c in range(len(text) - 126):
        least = min((rank[steps[i]], i) for i in range(c, c + 64))
        if least[0] <= 1000:
            wins[least[1]] += 1
    return [text[i : i + 64] for i in sorted(wins) if wins[i] >= 16]


def plain_fingerprints(rows):
    """n_chars, edited_sha256 and the sets of features of each text and of its edited text, in the order of documents."""
    counts = Counter(s for _, t in rows for s in plain_steps((t or "").encode()))
    order = sorted(range(1001), key=lambda s: (counts[s], s))
    rank = {s: (r if s >= 100 else 1001) for r, s in enumerate(order)}
    texts = [t or "" for _, t in rows]
    out = []
    for i, text in enumerate(texts):
        k = len(text) // 3
        edited = text[: len(text) - k] + texts[(i + 1) % len(texts)][:k]
        found = [plain_features(x.encode(), rank) or [x.encode()] * bool(x) for x in (text, edited)]
        out.append((len(text), hashlib.sha256(edited.encode()).hexdigest(), *found))
    return out


def feature_hashes(features):
    hashed = []
    for f in features:
        if len(f) == 64:
            sums, down = improbable.byte_sums(np.frombuffer(f, dtype=np.uint8))
            hashed.append(improbable.stretches(sums, down, np.array([0]), np.array([64])))
        else:
            hashed.append(improbable.whole_feature(f))
    return np.concatenate(hashed) if hashed else np.zeros(0, dtype=np.uint64)


def plain_digest(features):
    """As digest, bit by bit."""
    kept = list(dict.fromkeys(int(h) for h in feature_hashes(features)))
    filters = [[0] * 2048 for _ in range(-(-len(kept) // 160))]
    for i, h in enumerate(kept):
        for k in range(5):
            filters[i // 160][h >> 11 * k & 2047] = 1
    return f"{len(kept)}:{np.packbits(np.array(filters, dtype=np.uint8), axis=1).tobytes().hex()}" if kept else ""


def texts_of(draw, n):
    words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyzéß中") for _ in range(draw.randint(2, 9))) for _ in range(60)]
    return [" ".join(draw.choice(words) for _ in range(draw.choice([3, 30, 80, 200]))) for _ in range(n)]


def test_fingerprints_equal_a_plain_version(spark):
    draw = random.Random(3)
    texts = [*texts_of(draw, 14), "", None, "short", "a" * 700, "ab" * 400]
    texts += [texts[0], texts[3]]
    rows = [(i, t, 1, "w") for i, t in enumerate(texts)]
    out = {r["doc_id"]: r for r in rows_of(improbable.fingerprint_documents(spark.createDataFrame(rows, DOCS).repartition(5)))}
    placed = [(i, t) for i, t, _, _ in reversed(rows)]
    expected = plain_fingerprints(placed)
    assert len(out) == len(rows)
    for k, ((doc_id, text), (n, sha, own, edited)) in enumerate(zip(placed, expected, strict=True)):
        r = out[doc_id]
        following = out[placed[(k + 1) % len(placed)][0]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert r["fingerprint"] == plain_digest(own) and r["edited_fingerprint"] == plain_digest(edited), (doc_id, text)
        assert r["near_edited"] == improbable.likeness(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == improbable.likeness(r["fingerprint"], following["fingerprint"])
    assert out[0]["fingerprint"] == out[len(texts) - 2]["fingerprint"]


def test_fingerprints_of_repeated_null_and_no_rows(spark):
    assert rows_of(improbable.fingerprint_documents(spark.createDataFrame([], DOCS))) == []
    one = rows_of(improbable.fingerprint_documents(spark.createDataFrame([(1, "x" * 10, 0, "")], DOCS)))
    assert one[0]["near_next"] == 1.0 and one[0]["edited_sha256"] == hashlib.sha256(b"x" * 10).hexdigest()
    rows = [(None, "abc" * 50, 0, ""), (None, None, 0, ""), (2, "q", 0, ""), (2, "q", 0, ""), (2, "q", 0, "")]
    out = rows_of(improbable.fingerprint_documents(spark.createDataFrame(rows, DOCS)))
    assert len(out) == 5 and sum(r["near_next"] == 1.0 for r in out if r["doc_id"] == 2) == 2


def test_likeness_tells_edits_from_strangers():
    draw = random.Random(5)
    text = " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9))) for _ in range(4000))
    other = " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9))) for _ in range(4000))
    rank = improbable.ranks(improbable.counted([text.encode(), other.encode()]))
    prints = [improbable.digest(improbable.selected([t.encode()], rank)[0][1]) for t in (text, text[: len(text) * 2 // 3] + other[: len(text) // 3], other)]
    near, far = improbable.likeness(prints[0], prints[1]), improbable.likeness(prints[0], prints[2])
    assert near > 0.5 and far < 0.1 and near == improbable.likeness(prints[1], prints[0])
    assert improbable.likeness("", "") == 1.0 and improbable.likeness("", prints[0]) == 0.0


def near_words(words):
    """All words one edit apart, by what is left without one code point and by replaced ones."""
    left = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            left[i, w[:i] + w[i + 1 :]].add(w)
    out = {w: set() for w in words}
    for (i, short), some in left.items():
        for a in some:
            out[a] |= {b for b in some if a != b}
        if short in out:
            for a in some:
                out[a].add(short)
                out[short].add(a)
    return out


def plain_variants(counts):
    near, out = near_words(counts), {}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x.encode()), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), None if form[w] is None else counts[form[w]])
    return out


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


@pytest.mark.parametrize(("part", "least", "block", "large"), [(500, 16, 4096, 64), (20, 1, 5, 3), (3, 0, 16, 2), (10**9, 0, 4096, 64)])
def test_near_pairs_equal_all_pairs(spark, monkeypatch, part, least, block, large):
    for name, value in {"PART": part, "LEAST": least, "BLOCK": block, "LARGE": large, "TOGETHER": 200}.items():
        monkeypatch.setattr(spelling, name, value)
    draw = random.Random(part)
    words = {"".join(draw.choice("abé") for _ in range(draw.randint(6, 10))) for _ in range(250)} | {"a" * 6, "a" * 7, "a" * 8, "ab" * 40, "ab" * 40 + "a", "b" + "ab" * 40}
    words |= {"".join(draw.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(50)}
    pairs = spelling.near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).collect()
    near = near_words(words)
    assert Counter((r["a"], r["b"]) for r in pairs) == Counter((a, b) for a in words for b in near[a] if a.encode() < b.encode())


def test_variants_equal_a_plain_version(spark):
    draw = random.Random(11)
    stems = ["".join(draw.choice("abcdefgÀéÿ") for _ in range(draw.randint(6, 9))) for _ in range(30)]
    counts = {}
    for s in stems:
        n, w = draw.choice([5, 700, 4000]), s
        while n >= 5:
            counts[w] = n
            i = draw.randrange(len(w))
            w, n = draw.choice([w[:i] + w[i + 1 :] if len(w) > 6 else w + "q", w[:i] + draw.choice("abcx") + w[i:], w[:i] + draw.choice("xyz") + w[i + 1 :]]), n // draw.choice([3, 5, 6])
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows_of(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))}
    assert out == plain_variants(counts)


def test_words_and_edge_cases(spark):
    rows = [(1, "Straße STRASSE strasse Übermut ÜBERMUT übermut × " * 5, 0, ""), (2, None, 0, ""), (3, "", 0, ""), (None, "Overflow overflow " * 3, 0, ""), (4, "zzzzzzz" * 30000, 0, "")] + [(i, "alphabet betamax gamma " * 2, 0, "") for i in range(5, 260)]
    got = {r["word"]: r["n"] for r in rows_of(spelling.word_counts(spark.createDataFrame([*rows, rows[-1]], DOCS)))}
    assert got == plain_words([r[:2] for r in [*rows, rows[-1]]]) and "overflow" in got
    assert rows_of(spelling.spelling_variants(spark.createDataFrame([], DOCS))) == []


def test_variant_query_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    expected = plain_variants(plain_words([(r["doc_id"], r["text"]) for r in docs.collect()]))
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows_of(Q.op13_spelling_variants(spark, DATA))}
    assert out == expected
