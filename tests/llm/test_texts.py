"""Token counts, packing, SimHash, line and substring dedup against brute force."""

import hashlib
import math
import random
import sys
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quotewright.llm import common, line_chunks, packing, queries, simhash, similar, substrings, token_counts

from .conftest import DOCS, SMALL


def as_set(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def test_token_counts(spark, odd_documents, odd_texts, rows):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((d, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for d, t in odd_texts)
    columns = ("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert as_set(token_counts.token_counts(odd_documents), *columns) == want
    got = as_set(queries.op1_token_counts(spark, SMALL), *columns)
    assert got == Counter((d, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for d, t in rows)


def pieces_of(texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        for k, (a, b) in enumerate([(0, first), *((s, s + 1024) for s in range(first, len(ids), 1024))]):
            want[d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    return want


def check_packing(df, texts):
    got = df.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces_of(texts)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    total = sum(r["length"] for r in got)
    assert len(bins) <= math.ceil(total / 1024) * 1.02 + 1


def test_packing(spark, odd_documents, odd_texts, rows, monkeypatch):
    check_packing(queries.op10_best_two_fit(spark, SMALL), rows)
    monkeypatch.setattr(packing, "RANK_BLOCK", 3)
    check_packing(packing.best_two_fit(odd_documents), odd_texts)


def test_word_parts_are_encoded_once(monkeypatch):
    words = packing.WordIds(public_tokenizers.path(packing.MODEL))
    text = "\n".join(f"{stem}{sign}end, {stem}" for stem in ("stone", "Äpfel", "mountain", "x") for sign in "-.'/&")
    want, calls = words.encode(text), []
    monkeypatch.setattr(words, "encode", lambda t: calls.append(t) or packing.WordIds.encode(words, t))
    assert words.ids(text) == want
    assert len(calls) < 10  # signs and the line break; all runs of letters go to the model at once


def test_word_ids_are_those_of_whole_texts(monkeypatch):
    for limit, value in (("MOST", 30), ("LONGEST", 6), ("TEXTS", 7), ("RUN", 16)):
        monkeypatch.setattr(packing.WordIds, limit, value, raising=False)
    words = packing.WordIds(public_tokenizers.path(packing.MODEL))
    rng = random.Random(5)
    parts = [*"abstÀéßɏªа漢\u0301", *"'-.,!~…“\x00", *"07²Ⅷ", *" \n", "  ", "\n\n", "\r\n", *"\t\x1c\x85\xa0\u180e\u2028\u3000\ufeff", "'s", "'ll", " the", "<|endoftext|>", "<|end"]
    usual = ["one", " two", " Thrée", ",", ".", "-", "'t", "\n", " 5"]
    texts = ["".join(rng.choices(rng.choice((parts, usual)), k=rng.choice((0, 1, 3, 12, 60)))) for _ in range(600)]
    for kind in (pa.string(), pa.large_string()):
        assert list(words.texts(pa.array(texts, kind))) == [words.encode(t) for t in texts]
    assert list(words.texts(pa.array([], pa.string()))) == []


def test_best_two_fit_replaces_the_smallest():
    counts = np.zeros(11, dtype=np.int64)
    counts[[6, 3, 2]] = 1, 1, 2
    assert packing.fill(counts, 10) == [6, 2, 2]  # greedy 6 + 3 leaves 1; 2 + 2 fits the gap of 4
    plan = packing.plan_bins({6: 1, 3: 1, 2: 2}, 10)
    assert plan.bins == 2


def brute_simhash(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, threshold=2):
    """items: (doc_id, fp) with ids; smallest id reachable over links of ``threshold`` or fewer bits."""
    fps = sorted({f for _, f in items})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= threshold:
                parent[find(a)] = find(b)
    least = {}
    for d, f in items:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [(d, f"{f:016x}", least.get(find(f))) for d, f in items]


def test_simhash(spark, odd_documents, odd_texts, rows):
    for df, texts in ((queries.op3_simhash(spark, SMALL), rows), (simhash.near_duplicates(odd_documents), odd_texts)):
        want = Counter(brute_components([(d, brute_simhash(t)) for d, t in texts]))
        assert as_set(df, "doc_id", "fingerprint", "component_id") == want


def planted_fingerprints(threshold):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(200)]
    for f in fps[:60]:
        for _ in range(6):  # chains and stars around some
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, threshold + 1)))
            fps.append(f)
    return list(dict.fromkeys(fps))


@pytest.mark.parametrize("threshold", [2, 4])
@pytest.mark.parametrize("hot", [500_000, 0])
def test_links_connect_all_within_the_threshold(spark, monkeypatch, hot, threshold):
    monkeypatch.setattr(simhash, "HOT_ANCHOR", hot)
    monkeypatch.setattr(simhash, "PAIR_BLOCK", 64)
    fps = planted_fingerprints(threshold)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.similar_classes(spark.createDataFrame(signed, "fp long"), threshold)
    got = {tuple(x & (1 << 64) - 1 for x in (r["fp"], r["other"])) for r in links.collect()}
    groups = defaultdict(set)
    index = {f: i for i, f in enumerate(fps)}
    labels = common.roots(len(fps), *(np.array([index[p[k]] for p in got]) for k in (0, 1)))
    for f in fps:
        groups[labels[index[f]]].add(f)
    want = defaultdict(set)
    for d, _, c in brute_components([(i, f) for i, f in enumerate(fps)], threshold):
        want[c].add(fps[d])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_tables_of_whole_anchors(monkeypatch):
    monkeypatch.setattr(simhash, "HELD_ROWS", 10)
    rng = random.Random(8)
    anchors = sorted(rng.choices(range(12), k=90)) + [12] * 40
    stream = (pa.RecordBatch.from_pydict({"anchor": pa.array(anchors[i : i + 7], pa.int32())}) for i in range(0, len(anchors), 7))
    parts = [t.column("anchor").to_pylist() for t in simhash.whole_anchors(stream)]
    assert [a for p in parts for a in p] == anchors and len(parts) > 4
    assert sum(len(set(p)) for p in parts) == len(set(anchors))


def test_comparing_pairs_holds_few_of_them():
    """All pairs of 2500 fingerprints at one anchor, six million, are compared in blocks."""
    fp = np.random.default_rng(4).integers(1 << 62, size=2500)
    fp[-1] = fp[0] ^ 3
    tracemalloc.start()
    u, v = simhash.compare(np.zeros(2500, np.int32), fp, np.ones(2500, bool), 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (u.tolist(), v.tolist()) == ([max(fp[0], fp[-1])], [min(fp[0], fp[-1])])
    assert peak < 40 << 20


def test_batches_of_texts_are_small_and_whole(spark):
    texts = common.session(spark).range(0, 1500, 1, 1).select("id", F.repeat(F.lit("abcdefgh "), 1000).alias("text"))
    rows = common.batches(texts, lambda rows: {"id": rows["id"], "held": [rows["text"].nbytes] * len(rows["id"])}, "id long, held long").collect()
    assert sorted(r["id"] for r in rows) == list(range(1500))
    assert max(r["held"] for r in rows) < 5 << 20


def test_workers_let_go_of_values_of_other_modules(spark, monkeypatch):
    class Frame:
        def mapInArrow(self, run, schema):
            return run

    def task(module, name=None):
        def fn(rows):
            if name:
                common.worker_value(name, lambda: rows)
            return {"n": [len(store)]}

        fn.__module__ = module
        (out,) = common.batches(Frame(), fn, "n long")(iter([pa.RecordBatch.from_pydict({"n": [0]})]))
        return out.column("n").to_pylist()

    monkeypatch.setitem(sys.__dict__, "_corpus_worker_values", store := {})
    monkeypatch.setitem(sys.__dict__, "_corpus_worker_owner", None)
    assert task("packing", "words") == task("packing", "words") == task("packing") == [1]
    assert task("toxicity") == [0]


def test_code_is_perfect():
    anchors = simhash.Anchors()
    assert (anchors.extra[anchors.start[:-1]] == 0).all()
    assert (np.add.reduceat(anchors.extra == 0, anchors.start[:-1]) == 1).all()


def test_connected_follows_long_chains(spark):
    edges = [(i + 1, i) for i in range(1, 60)] + [(100, 101), (102, 101)]
    got = {r["node"]: r["root"] for r in common.connected(spark.createDataFrame(edges, "u long, v long"), "t").collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, 101: 100, 102: 100}


def brute_kept(items):
    """Ids that stay of (doc_id, text): first by fingerprints of five words, then by shares of common shingles."""
    first = {d for d, _, c in brute_components([(d, brute_simhash(t, 5)) for d, t in items]) if d == c}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in items if d in first and (w := (t or "").encode().lower().split())}
    ids = sorted(sets)
    near = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    at = {d: i for i, d in enumerate(ids)}
    labels = common.roots(len(ids), *(np.array([at[p[k]] for p in near], dtype=int) for k in (0, 1)))
    return first - {d for d in ids if labels[at[d]] != at[d]}


def test_keep_first(spark):
    data = [(5, "a b c d"), (3, "a b c d"), (9, "other words stay here"), (None, "a b c d"), (3, "a b c d")]
    kept = simhash.keep_first(spark.createDataFrame(data, "doc_id long, text string"))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [3, 3, 9, None]


def edited(words, rng, share):
    return [f"{w}x" if rng.random() < share else w for w in words]


def test_near_copies_go_and_others_stay(spark):
    """Copies with fewer and more edits than 0.8 allows, of several originals and in chains."""
    rng = random.Random(12)
    items, d = [], 0
    for n in (30, 200, 3000):
        for _ in range(4):
            words = [f"w{rng.randrange(5000)}" for _ in range(n)]
            for share in (0, 0.005, 0.01, 0.02, 0.06, 0.1, 0.3):
                items.append((d := d + 1, " ".join(edited(words, rng, share))))
    rng.shuffle(items)
    kept = simhash.keep_first(spark.createDataFrame([(*x, 1, 2) for x in items], "doc_id long, text string, band int, node int"))
    assert kept.columns == ["doc_id", "text", "band", "node"]
    got = {r["doc_id"] for r in kept.collect()}
    assert got == brute_kept(items) and 12 < len(got) < len(items) - 20


def test_near_dedup_of_odd_rows(spark, odd_documents, odd_texts):
    kept = simhash.keep_first(odd_documents)
    want = brute_kept([x for x in odd_texts if x[0] is not None])
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(d for d, _ in odd_texts if d is None or d in want)
    assert kept.columns == odd_documents.columns and simhash.keep_first(odd_documents.limit(0)).collect() == []


@pytest.mark.parametrize("part", [512, 20])
def test_copies_round_an_original_in_the_middle_go(spark, monkeypatch, part):
    """Groups of copies that are like their original, but not each other, which is neither first nor last of them."""
    monkeypatch.setattr(similar, "PART", part)
    rng = random.Random(31)
    items = []
    for g in range(2):
        words = [f"w{rng.randrange(50_000)}" for _ in range(250)]
        for k in range(120):
            at = rng.sample(range(250), 5) if k != 57 else ()
            items.append((1000 * g + k, " ".join(f"{w}x{k}" if i in at else w for i, w in enumerate(words))))
    docs = spark.createDataFrame(items, "doc_id long, text string")
    gone = similar.copies(docs, spark.createDataFrame([], "u long, v long"))
    assert sorted(r["doc_id"] for r in gone.collect()) == [d for d, _ in items if d % 1000]


def test_groups_form_over_both_kinds_of_links(spark, monkeypatch):
    """1 and 2 have near fingerprints, 2 and 3 like shingles; 1 and 3 have neither."""
    words = [f"w{i}" for i in range(100)]
    items = [(1, "quite another text"), (2, " ".join(words)), (3, " ".join([*words, "end"])), (4, "a text of its own")]
    found = spark.createDataFrame([(1, "", 1), (2, "", 1), (3, "", 3), (4, "", 4)], "doc_id long, fingerprint string, component_id long")
    monkeypatch.setattr(simhash, "near_duplicates", lambda *_: found)
    kept = simhash.keep_first(spark.createDataFrame(items, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4]


def test_bands_agree_with_the_share_of_common_shingles():
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(4000)]
    a, b = (similar.shingle_set(" ".join(x), 5) for x in (words, edited(words, rng, 0.02)))
    share = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert similar.alike(a.tobytes(), b.tobytes(), share - 0.001) and not similar.alike(a.tobytes(), b.tobytes(), share + 0.001)
    assert 0.8 < share and (similar.bands(a) == similar.bands(b)).any() and (similar.bands(a) == similar.bands(a.copy())).all()
    assert len(similar.shingle_set("", 5)) == 0 and len(similar.shingle_set("one two", 5)) == 1
    assert not similar.alike(b"", b"", 0.8)


def brute_substrings(texts, length=20):
    first, split = {}, []
    for d, t in texts:
        words = (t or "").encode().split()
        split.append(words)
        for i in range(len(words) - length + 1):
            w = tuple(words[i : i + length])
            at = (math.inf if d is None else d, i)
            first[w] = min(first.get(w, at), at)
    out = []
    for (d, _), words in zip(texts, split, strict=True):
        gone = set()
        for i in range(len(words) - length + 1):
            if first[tuple(words[i : i + length])] < (math.inf if d is None else d, i):
                gone.update(range(i, i + length))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_substrings(spark, rows):
    got = as_set(queries.op9_substrings(spark, SMALL), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_substrings(rows)


def test_substrings_with_overlaps_and_odd_rows(spark, odd_texts):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(12)]
    shared = [" ".join(rng.choices(words, k=rng.randint(18, 60))) for _ in range(6)]
    texts = [t for t in odd_texts if not t[1] or len(t[1]) < 1000]
    texts += [(100 + i, " ".join(rng.choice(shared) if rng.random() < 0.5 else " ".join(rng.choices(words, k=15)) for _ in range(8))) for i in range(40)]
    texts += [(7, "tick " * 70), (None, "tick " * 30), (None, shared[0])]
    df = substrings.substring_dedup(spark.createDataFrame(texts, "doc_id long, text string"))
    df = df.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    assert as_set(df, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(texts)


def brute_lines(texts):
    seen, out = {}, []
    cut = []
    for d, t in texts:
        lines = (t or "").split("\n")
        hashes = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        start, parts = 0, []
        for i, h in enumerate(hashes):
            if i == len(lines) - 1 or (h + 31 * (hashes[i - 1] if i else 0)) % 4 == 0:
                parts.append((start, tuple(lines[start : i + 1])))
                start = i + 1
        cut.append(parts)
        for s, body in parts:
            at = (math.inf if d is None else d, s)
            seen[body] = min(seen.get(body, at), at)
    for (d, t), parts in zip(texts, cut, strict=True):
        at = math.inf if d is None else d
        keep = [b for s, b in parts if len(b) < 2 or seen[b] == (at, s)]
        gone = sum(len(b) for _, b in parts) - sum(map(len, keep))
        text = "\n".join(x for b in keep for x in b) if gone else t
        out.append((d, text, gone))
    return Counter(out)


def test_line_dedup(spark, odd_documents, odd_texts):
    rng = random.Random(2)
    lines = [f"line {i}" for i in range(40)]
    block = lines[:12]
    texts = odd_texts + [(50 + i, "\n".join(rng.choices(lines, k=5) + block + rng.choices(lines, k=5))) for i in range(20)]
    texts += [(5, "\n".join(block)), (None, "\n".join(block)), (5, "\n".join(block))]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1) for d, t in texts], f"{DOCS}, digest int")
    got = line_chunks.line_dedup(df)
    assert got.columns == [*df.columns, "lines_removed"]
    assert as_set(got, "doc_id", "text", "lines_removed") == brute_lines(texts)
    assert sum(r["lines_removed"] for r in got.collect()) > 100
    assert not [r for r in got.collect() if r["n_chars"] != len(r["text"] or "")]


def test_repeated_passages_of_few_lines_go(spark):
    """Passages of over 50 words, of one to five lines, inside otherwise different documents; shorter ones stay."""
    rng = random.Random(6)

    def line(n):
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))

    texts, want = [], {}
    for k, sizes in enumerate(([51], [26, 26], [20, 20, 20], [10, 15, 15, 15], [60, 2, 3], [2, 3, 60], [12] * 5, [50], [25, 25])):
        passage = [line(n) for n in sizes]
        for d in range(3):
            before, after = [line(9), line(30)], [line(8), line(28)]
            inside = [x for y in passage for x in ((y, "") if d == 1 else (y,))][: None if d != 1 else -1]
            texts.append((10 * k + d, "\n".join(before + inside + after)))
            want[10 * k + d] = before + (inside if d == 0 or sum(sizes) <= 50 else []) + after
    own = [line(30), line(30)]
    texts += [(900, "\n".join(own * 4)), (901, "\n".join(["tick"] * 200)), (None, own[0] + "\n" + own[1])]
    want |= {900: own, 901: ["tick"] * 51, None: [""]}
    got = line_chunks.passage_dedup(spark.createDataFrame(texts, "doc_id long, text string"))
    # chunks may take some lines of the short ones as well
    short = {d for k in (7, 8) for d in (10 * k + 1, 10 * k + 2)}
    found = {r["doc_id"]: r["text"].split("\n") for r in got.collect()}
    assert {d: t for d, t in found.items() if d not in short | {901}} == {d: t for d, t in want.items() if d not in short | {901}}
    assert set(found[901]) == {"tick"} and all(len([x for x in found[d] if x]) >= 4 for d in short)
    assert line_chunks.passage_dedup(spark.createDataFrame([], DOCS)).collect() == []


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    for operator in (token_counts.token_counts, packing.best_two_fit, simhash.near_duplicates, simhash.keep_first,
                     substrings.substring_dedup, line_chunks.line_dedup):
        assert operator(empty).collect() == []
