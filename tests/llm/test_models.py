"""Main text, quality, vector search, decontamination, toxicity and the pipeline."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quotewright.llm import common, decontaminate, main_text, packing, quality, queries, toxicity, vectors

from .conftest import DOCS, SMALL
from .test_texts import as_set, brute_kept, brute_lines, check_packing

PAGE = """<html><head><title>T</title><style>p{}</style><script>if (a < b) "</p>"</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
<div class="cookie-notice">We use cookies to improve your visit, please accept all of them now.</div>
<article><h1>A &amp; B</h1><p>First  paragraph<br>of the&nbsp;text with <b>bold</b> words, long enough to count as content.
<p>Second one.<ul><li>point<li>other &#233;</ul><form><input>Mail <button>Go</button></form>
<table><tr><td>cell<td>next</table></article>
<section id=comments><p>I liked this very much and have a lot to say about it in many words.</p></section>
<aside>Related</aside><footer>&copy; nobody</footer></body></html>"""


@pytest.mark.parametrize("html, text", [
    (PAGE, "A & B\n\nFirst paragraph of the text with bold words, long enough to count as content.\n\nSecond one.\n\npoint\n\nother é\n\ncell\n\nnext"),
    ("", ""), ("plain  text", "plain text"), ("<p></p>", ""), ("<![weird[ x ]]><p>a", "a"), ("</div></p><p>x</b>y", "xy"),
    ("<div>" * 3000 + "deep", "deep"), ("<nav>only a menu</nav>", ""),
])
def test_main_text(html, text):
    assert main_text.main_text(html) == text


def test_main_text_query(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r["page_id"]: r for r in queries.op2_main_text(spark, SMALL).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        text = got[r["page_id"]]["text"]
        assert got[r["page_id"]]["n_chars"] == len(text) and got[r["page_id"]]["url"] == r["url"]
        assert text and "track(" not in text and "&amp;" not in text and "<p>" not in text and "  " not in text
    odd = spark.createDataFrame([(1, None, None, 5), (None, "u", "", 6), (1, "u", "<p>x", 7), (1, "u", "<p>x", 7)], "page_id long, url string, html string, text int")
    assert as_set(main_text.extract(odd), "page_id", "url", "text", "n_chars") == Counter({(1, None, "", 0): 1, (None, "u", "", 0): 1, (1, "u", "x", 1): 2})


def test_smoothing_keeps_flat_lines():
    assert np.allclose(main_text.smoothed(np.full(7, 3.0)), 3.0)


def test_quality_learns_labels(spark, documents):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op5_quality(spark, SMALL).collect()}
    assert len(got) == documents.count()
    assert np.mean([got[d]["keep"] == (q == 1) for d, q in labels.items() if d in got]) > 0.95


def test_quality_holds_out(spark):
    big = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{big}/labels.parquet")
    got = quality.quality(spark.read.parquet(f"{big}/documents.parquet"), labels.where("doc_id % 2 = 0"))
    pairs = got.join(labels.where("doc_id % 2 = 1"), "doc_id").select("keep", "quality").collect()
    assert np.mean([r["keep"] == (r["quality"] == 1) for r in pairs]) > 0.95


def test_sparse_sites_shrink_towards_the_global_prior(spark):
    many = [("big", "a", 1000, 950.0, 0.5), ("bad", "a", 1000, 20.0, 0.5), ("tiny", "a", 2, 0.0, 0.5)]
    k = quality.shrinkage(spark.createDataFrame(many, "host string, path string, n long, good double, prior double"))
    assert 2 <= k < 10
    same = [(f"h{i}", "a", 100, 50.0, 0.5) for i in range(9)]
    assert quality.shrinkage(spark.createDataFrame(same, "host string, path string, n long, good double, prior double")) == quality.SHRINK[1]


def test_quality_without_labels_and_with_odd_rows(spark, odd_documents):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.quality(odd_documents, none).collect()
    assert len(got) == odd_documents.count() and {r["score"] for r in got} == {0.5}
    assert quality.quality(odd_documents.limit(0), none).collect() == []


def brute_top(vecs, every, k):
    out = []
    for q, v in vecs.items():
        if q % every == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in vecs.items() if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return Counter(out)


@pytest.mark.parametrize("shard, block, seen", [(20_000, 2_000, 4_096), (30, 2, 7)])
def test_vectors(spark, monkeypatch, shard, block, seen):
    for name, value in (("SHARD", shard), ("QUERY_BLOCK", block), ("TRAVERSED", seen)):
        monkeypatch.setattr(vectors, name, value)
    rng = random.Random(8)
    vecs = {i: [rng.randint(-3, 3) for _ in range(12)] for i in range(150)}
    vecs |= {i: vecs[3] for i in range(150, 190)} | {190: [5], 191: []}
    rows = [(i, [x / 256 for x in v], 0) for i, v in vecs.items()]
    rows += [rows[0], (None, [1.0], 0), (500, None, 0), (550, [None, 1.0], 0), (600, [float("nan")], 0), (650, [float("inf")], 0)]
    got = vectors.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int"), every=10, k=5)
    assert as_set(got, "query_id", "rank", "vec_id", "score") == brute_top(vecs, 10, 5)


def test_vectors_rounds_down_and_takes_empty_tables(spark):
    two = spark.createDataFrame([(0, [-0.001, 0.5]), (1, [0.999, -0.5])], "vec_id long, embedding array<float>")
    assert as_set(vectors.nearest(two), "query_id", "rank", "vec_id", "score") == Counter([(0, 1, 1, -1 * 255 + 128 * -128)])
    assert vectors.nearest(two.limit(0)).collect() == []


ITEM = "The quick brown fox jumps over the lazy dog, and then it runs back home again to sleep; nobody has ever seen it do so twice in a row."


def edited(text, edits, rng):
    chars = list(text)
    for at in rng.sample(range(len(chars)), edits):
        chars[at] = rng.choice(["", "z", chars[at] + "q"])
    return "".join(chars)


def brute_leak(text, patterns):
    """Whether any pattern occurs with at most its budget of edits."""
    text = decontaminate.normalised(text or "")
    for pattern, budget in patterns:
        row = [0] * (len(text) + 1)
        for i, c in enumerate(pattern):
            new = [i + 1]
            for j, d in enumerate(text):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        if min(row) <= budget:
            return True
    return False


def test_leaks_against_full_alignment(spark):
    rng = random.Random(4)
    filler = "other plain words that say nothing of note and fill the page with more of the same old talk"
    texts = [(i, f"{filler} {edited(ITEM, i % 14, rng)}\n{filler}") for i in range(60)]
    texts += [(100, None), (101, ""), (102, ITEM.upper().replace(" ", "\n\t")), (103, ITEM[:45]), (104, filler * 300), (None, ITEM), (0, filler), (105, ITEM[20:120])]
    bench = spark.createDataFrame([(7, ITEM, 1), (8, None, 1), (None, "x", 1), (9, "too short", 1), (7, ITEM, 1)], "item_id long, text string, doc_id int")
    docs = spark.createDataFrame([(d, t, "en", "s", 0, 1) for d, t in texts], f"{DOCS}, item_id int")
    known = decontaminate.patterns_of([(7, ITEM)])
    patterns = list(zip(known.text, known.budget.tolist(), strict=True))
    want = Counter((d, t) for d, t in texts if not brute_leak(t, patterns))
    assert as_set(decontaminate.decontaminate(docs, bench), "doc_id", "text") == want
    hit = {r["doc_id"] for r in decontaminate.contaminated(docs, bench).collect()}
    assert hit == {d for d, t in texts if brute_leak(t, patterns)} and {0, 1, 2, 102, 105, None} <= hit


def test_benchmark_in_several_passes(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    once = as_set(decontaminate.contaminated(docs, bench), "doc_id", "item_id", "regions", "edits", "start", "end")
    verbatim = {(d["doc_id"], b["item_id"]) for d in docs.collect() for b in bench.collect() if b["text"] in (d["text"] or "")}
    assert verbatim and verbatim <= {k[:2] for k in once}
    monkeypatch.setattr(decontaminate, "PASS_CHARS", 2000)
    assert as_set(decontaminate.contaminated(docs, bench), "doc_id", "item_id", "regions", "edits", "start", "end") == once
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({k[0] for k in once})
    assert decontaminate.contaminated(docs, bench.limit(0)).collect() == [] and decontaminate.decontaminate(docs.limit(0), bench).collect() == []


def test_toxicity_holds_out(spark):
    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    got = toxicity.toxicity(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1").withColumnRenamed("toxic", "label"), "doc_id").collect()
    bad, clean = [r["toxic"] for r in got if r["label"] == 1], [r["toxic"] for r in got if r["label"] == 0]
    assert np.mean(bad) > 0.8 and np.mean(clean) < 0.01
    assert all(0 <= r["severity"] <= toxicity.GRADES - 1 and 0 <= r["grade"] < toxicity.GRADES for r in got)
    assert np.mean([r["severity"] for r in got if r["label"] == 1]) > np.mean([r["severity"] for r in got if r["label"] == 0]) + 0.5


def test_ordinal_fit_shares_weights():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 2))
    z = x @ [2.0, -1.0] + rng.logistic(size=4000)
    weights, cuts = toxicity.fit_ordinal(x, (z > 0).astype(int) + (z > 2).astype(int), steps=2000)
    assert np.allclose(weights, [2, -1], atol=0.2) and np.allclose(cuts, [0, 2], atol=0.2)


def test_toxicity_of_odd_rows(spark, odd_documents):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(odd_documents, none).collect()
    assert len(got) == odd_documents.count() and not any(r["toxic"] or r["severity"] for r in got)
    assert as_set(toxicity.without_toxic(odd_documents, odd_documents, none), *odd_documents.columns) == as_set(odd_documents, *odd_documents.columns)
    assert toxicity.toxicity(odd_documents.limit(0), none).collect() == []


def test_pipeline_stages_agree_with_brute_force(spark, documents):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "best_fit_packing"]
    labels, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("labels", "benchmark"))
    kept = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r["doc_id"], r["text"]) for r in kept.collect()]
        kept = common.stored(stage(spark, kept, SMALL), f"test-{name}")
        after = Counter((r["doc_id"], r["text"]) for r in kept.collect())
        assert kept.columns == documents.columns and after
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.toxicity(documents, labels).where("toxic").collect()}
            assert after == Counter(x for x in before if x[0] not in bad)
        if name == "line_dedup":
            assert after == Counter({(d, t): n for (d, t, gone), n in brute_lines(before).items() if not gone or t.strip()})
        if name == "near_dedup":
            first = brute_kept(before)
            assert after == Counter(x for x in before if x[0] in first) and len(first) < len(before)
        if name == "decontamination":
            hit = {r["doc_id"] for r in decontaminate.contaminated(spark.createDataFrame(before, "doc_id long, text string"), bench).collect()}
            assert after == Counter(x for x in before if x[0] not in hit)
    texts = [(r["doc_id"], r["text"]) for r in kept.collect()]
    check_packing(corpus_pipeline.run(spark, SMALL), texts)


def test_stages_take_empty_tables(spark, documents):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents.limit(0), SMALL).collect() == []


def test_words_of_a_text_with_special_strings():
    import public_tokenizers
    words = packing.WordIds(public_tokenizers.path(packing.MODEL))
    for text in ("a <|endoftext|> b", " a", "a  b", "a \n b", "a\nb c", "don't we've it's", "x1 22 333"):
        assert words.ids(text) == words.encode(text)


def test_line_dedup_stage_with_a_column_of_the_counts_name(spark):
    body = "\n".join(f"line {i} of a passage that is long enough to count" for i in range(30))
    rows = [(1, body, 7), (2, body, 8), (3, "other", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lines_removed int")
    kept = corpus_pipeline.line_dedup(spark, docs, SMALL)
    assert kept.columns == docs.columns
    found = {r.doc_id: (r.text, r.lines_removed) for r in kept.collect()}
    assert found[1] == (body, 7) and found[3] == ("other", 9) and found.get(2, ("", 8))[1] == 8


def test_rows_with_texts_hold_them_once(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "a", "y")], "doc_id long, text string, row string")
    rows, texts = common.with_rows(docs)
    assert rows.columns == ["row"]
    assert [texts({"row": pa.array([{"text": None}, {"text": "a"}])})] == [["", "a"]]


def test_workers_let_go_of_other_values():
    made = []
    for name in ("a", "a", "b", "a"):
        common.worker_value(f"test {name}", lambda name=name: made.append(name) or name)
    assert made == ["a", "b", "a"]
