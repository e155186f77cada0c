"""Alignment, sharding and whitening against brute force."""

import bisect
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quotewright.llm import alignment, queries, sharding, whitening

from .conftest import DOCS, SMALL

# --- alignment ---------------------------------------------------------------------------


def tokens_of(texts):
    """(ids of a, their ends, ids of b, their ends) per text, None without tokens; by the libraries on whole texts."""
    a_of = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_of.encode_special_tokens = True
    b_of = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    names = dict(zip([chr(b) for b in sorted(plain)], sorted(plain), strict=True))
    names |= {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - plain))}
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        a, b = a_of.encode(f" {text}", add_special_tokens=False).ids, b_of.encode(text)
        a_parts = [bytes(names[c] for c in a_of.id_to_token(i)) for i in a]
        b_parts = [bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode() for i in b]
        same = b"".join(a_parts) == b"".join(b_parts) == f" {text}".encode()
        out.append((a, np.cumsum([*map(len, a_parts)]).tolist(), b, np.cumsum([*map(len, b_parts)]).tolist()) if same else None)
    return out


def brute_alignment(docs):
    found = []
    for tokens in tokens_of([t for _, t in docs]):
        if tokens is None:
            found.append(None)
            continue
        a, a_ends, b, b_ends = tokens
        groups, links, low = [], [], 0
        for cut in sorted({*a_ends} & {*b_ends}):
            held_a = range(bisect.bisect_right(a_ends, low), bisect.bisect_right(a_ends, cut))
            held_b = range(bisect.bisect_right(b_ends, low), bisect.bisect_right(b_ends, cut))
            groups.append(",".join(str(a[i]) for i in held_a) + "|" + ",".join(str(b[j]) for j in held_b))
            start = lambda ends, i: ends[i - 1] if i else 0
            links += [(a[i], b[j]) for i in held_a for j in held_b if start(a_ends, i) < b_ends[j] and start(b_ends, j) < a_ends[i]]
            low = cut
        found.append((len(a), len(b), groups, links))
    docs_of = Counter(p for f in found if f for p in {*f[3]})
    highest = defaultdict(int)
    for (a, _), n in docs_of.items():
        highest[a] = max(highest[a], n)
    rows = []
    for (doc, _), f in zip(docs, found, strict=True):
        if f is None:
            rows.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = f
            best = sum(docs_of[p] == highest[p[0]] for p in links)
            sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
            rows.append((doc, n_a, n_b, len(groups), len(links), best, sum(docs_of[p] for p in links), sha))
    return Counter(rows)


ALIGN_COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def align_rows(df):
    assert df.columns == ALIGN_COLUMNS
    return Counter(map(tuple, df.collect()))


def test_leaves_are_the_shared_ends():
    rng = random.Random(1)
    for _ in range(3_000):
        m = rng.randint(1, 40)
        a, b = ([*sorted(rng.sample(range(1, m + 1), rng.randint(0, m))), m + 1] for _ in range(2))
        found = alignment.leaves(a, b)
        assert [a[i - 1] for i, _ in found] == [b[j - 1] for _, j in found] == sorted({*a} & {*b})


@pytest.mark.parametrize("most", [alignment.FREQUENT, 40, 0])
def test_alignment_of_odd_texts(odd_documents, odd_texts, most):
    """Also with so small a table of frequent pairs that links have to be joined with their counts."""
    assert align_rows(alignment.align(odd_documents, most=most)) == brute_alignment(odd_texts)


def test_alignment_query(spark, rows):
    assert align_rows(queries.op11_alignment(spark, SMALL)) == brute_alignment(rows)


def test_alignment_of_random_texts(spark):
    rng = random.Random(5)
    parts = ["the", " ", "  ", "\n", "naïve", "日本", "🙂", "<s>", "<|endoftext|>", "don't", "1234", "x" * 70, "\t", "é", ".", "▁", " ", "﻿", "ndthe"]
    texts = [(i, "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 25)))) for i in range(800)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert align_rows(alignment.align(df)) == brute_alignment(texts)


def test_alignment_of_a_long_text_without_spaces_and_of_nothing(spark):
    texts = [(1, "ab\n" * 100_000), (2, "ab\n" * 100_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert align_rows(alignment.align(df)) == brute_alignment(texts)
    assert alignment.align(df.limit(0)).collect() == []


def test_aligned_groups_are_the_digest(spark, rows):
    df = spark.createDataFrame(rows[:40], "doc_id long, text string")
    shas = {r["doc_id"]: r["groups_sha256"] for r in alignment.align(df).collect()}
    for r in alignment.aligned_groups(df).collect():
        text = ";".join(",".join(map(str, g["a"])) + "|" + ",".join(map(str, g["b"])) for g in r["groups"])
        assert (hashlib.sha256(text.encode()).hexdigest() if text else "") == shas[r["doc_id"]]


# --- sharding ----------------------------------------------------------------------------


def brute_shards(docs, shards, nodes, slack=0.0):
    """Keys one by one in the order of the ring, each to the first shard clockwise that has room."""
    md5 = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    ring = sorted((md5(f"shard {s} node {r}"), s) for s in range(shards) for r in range(nodes))
    places = [p for p, _ in ring]
    keys = []
    for doc, text in docs:
        raw = (text or "").encode()
        key, size, crc = "" if doc is None else str(doc), len(raw) + 16, zlib.crc32(raw)
        segment = bisect.bisect_left(places, md5(key)) % len(ring)
        keys.append((segment, md5(f"{key}|{size}|{crc}"), doc if doc is not None else -1, size, crc, doc))
    room, used, out = sharding.capacities(len(docs), shards, slack), [0] * shards, []
    for segment, _, _, size, crc, doc in sorted(keys, key=lambda k: k[:5]):
        at = segment
        while not room[ring[at][1]]:
            at = (at + 1) % len(ring)
        shard = ring[at][1]
        out.append((doc, size, crc, shard, used[shard]))
        room[shard] -= 1
        used[shard] += 1
    return Counter(out)


@pytest.mark.parametrize(("shards", "nodes", "slack"), [(40, 100, 0.0), (7, 5, 0.0), (7, 5, 0.3), (1, 1, 0.0)])
def test_shards(spark, rows, odd_texts, shards, nodes, slack):
    docs = rows + odd_texts
    df = spark.createDataFrame([(d, t, 5, "x", 1) for d, t in docs], "doc_id long, text string, shard int, place string, mix int").repartition(5)
    assert Counter(map(tuple, sharding.assign(df, shards, nodes, slack).collect())) == brute_shards(docs, shards, nodes, slack)


def check_law(got, shards):
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == [*range(len(v))] for v in slots.values())
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= {*range(shards)}


def test_shard_query(spark, rows):
    got = queries.op12_ring_shards(spark, SMALL).collect()
    check_law(got, 40)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in rows)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


def test_one_key_with_a_third_of_the_rows(spark, monkeypatch):
    """Equal rows, and rows of one id with different texts; ranked in blocks of a few rows."""
    monkeypatch.setattr(sharding, "RANK_BLOCK", 50)
    docs = [(7, "same")] * 400 + [(7, f"t{i}") for i in range(400)] + [(None, None)] * 200 + [(i, "x") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(9)
    got = sharding.assign(df, 40).collect()
    check_law(got, 40)
    assert Counter(map(tuple, got)) == brute_shards(docs, 40, 100)


def test_few_rows_move_to_a_new_shard(spark):
    """Ideally one row in 41 moves; bounded loads move some more, and with slack hardly any."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    moved = {}
    for slack in (0.0, 0.25):
        a, b = (sharding.assign(df, n, slack=slack).select("doc_id", F.col("shard").alias(f"s{n}")) for n in (40, 41))
        moved[slack] = a.join(b, "doc_id").where("s40 <> s41").count() / 20_000
        assert max(r["count"] for r in a.groupBy("s40").count().collect()) <= 500 * (1 + slack)
    assert moved[0.0] < 0.08 and moved[0.25] < 0.035


def test_sharded_documents_and_files(spark, tmp_path):
    docs = [(i % 50, f"text {i % 60}", "en", "s", 1) for i in range(200)] + [(None, None, None, None, None)] * 3
    df = spark.createDataFrame(docs, DOCS)
    out = sharding.shard(df, 8)
    assert out.columns == [*df.columns, "shard", "slot"]
    got = out.collect()
    check_law(got, 8)
    assert Counter(tuple(r)[:5] for r in got) == Counter(docs)
    for _ in range(2):  # a repeated job replaces its files
        sharding.write_shards(out, str(tmp_path / "shards"), 10)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == len(docs)
    assert all(r["slot"] // 10 == r["least"] // 10 for r in back.groupBy(F.input_file_name()).agg(F.min("slot").alias("least"), F.max("slot").alias("slot")).collect())
    assert sharding.digest(df.limit(0)).collect() == []


# --- whitening ---------------------------------------------------------------------------


def brute_components(x):
    distinct = np.unique(x, axis=0).astype(float)
    centred = distinct - distinct.mean(axis=0)
    values, q = np.linalg.eigh(centred.T @ centred / len(distinct))
    return distinct, values[::-1], q[:, ::-1]


def check_whitened(df, vectors, ids, k=4):
    """Rows against a full eigendecomposition, each component up to its sign."""
    x = np.array([[int(np.floor(256 * c)) for c in v] for v in vectors])
    distinct, values, q = brute_components(x)
    n, sums = len(distinct), [int(s) for s in distinct.sum(axis=0)]
    z = (x - distinct.mean(axis=0)) @ q[:, :k] / np.sqrt(values[:k])
    got = defaultdict(list)
    for r in df.collect():
        assert r["n"] == n and r["identity_error"] < 1e-8
        assert abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-9
        got[r["vec_id"], r["deviation"]].append((r["component"], r["whitened"]))
    want = defaultdict(list)
    for i, row in zip(ids, range(len(x)), strict=True):
        want[i, sum((n * int(a) - s) ** 2 for a, s in zip(x[row], sums, strict=True))] += [(c + 1, z[row, c]) for c in range(k)]
    assert got.keys() == want.keys()
    signs = {}
    for key in want:
        a, b = sorted(got[key]), sorted(want[key])
        assert [c for c, _ in a] == [c for c, _ in b]
        for (c, value), (_, wanted) in zip(a, b, strict=True):
            if abs(wanted) > 1e-3 and len(want[key]) == k:
                signs.setdefault(c, np.sign(value * wanted))
                assert abs(value * signs[c] - wanted) < 1e-7


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    check_whitened(queries.op13_whitening(spark, SMALL), [r["embedding"] for r in rows], [r["vec_id"] for r in rows])


@pytest.mark.parametrize(("n", "d", "spread"), [(300, 6, 0.6), (50, 3, 0.5), (400, 120, 0.97), (900, 40, 1.0)])
def test_whitening_of_random_vectors(spark, n, d, spread):
    """Fewer dimensions than the block, more than rows allow, falling and flat spectra; unsound and repeated rows."""
    rng = np.random.default_rng(n)
    vectors = (rng.standard_normal((n, d)) * spread ** np.arange(d)).tolist()
    vectors += vectors[:20]
    ids = [*range(n), *range(18), 3, None]
    bad = [(1, None, 0), (2, [None] * d, 0), (3, [float("nan")] * d, 0), (4, [float("inf")] * d, 0)]
    df = spark.createDataFrame([(i, v, 1) for i, v in zip(ids, vectors, strict=True)] + bad, "vec_id long, embedding array<double>, component int")
    check_whitened(whitening.whiten(df), vectors, ids, min(4, d))


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])], [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).collect() == []
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], schema)).collect()
    assert {r["component"] for r in line} == {1} and abs(line[0]["explained"] - 1) < 1e-12
    ragged = whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 4.0]), (3, [])], schema))
    assert ragged.count() == 6 and {r["n"] for r in ragged.collect()} == {3}


def test_whitening_beyond_longs(spark):
    """Entries that a long times 256 cannot hold stay at its ends; deviations beyond it are missing."""
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert got and all(r["deviation"] is None or r["deviation"] >= 0 for r in got) and any(r["deviation"] is None for r in got)
