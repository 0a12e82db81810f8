"""Links that pages hide, plain versions of the two classifiers, and the pipeline on odd tables."""

import math
import random
import re

import corpus_pipeline
import pytest
import zstandard
from pyspark.sql import functions as F

from meridian.llm import quality, sampling, toxicity, urls
from meridian.llm.common import Work, fold, table
from test_operators import prose

SMALL = "/root/testdata/sf0.001"
ROOT = [urls.Rule("block", "root.net", "/"), urls.Rule("block", "bad.com", "/x")]


def verdicts(spark, pages, rules, **more):
    frame = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    for name, value in more.items():
        frame = frame.withColumn(name, F.lit(value))
    return [r.verdict for r in urls.judge(Work(spark, "t"), frame, rules).orderBy("page_id").collect()]


def test_links_in_tags_with_signs_in_comments_and_to_roots(spark):
    link = lambda href, before="": f'<link {before} rel="canonical" href="{href}">'
    pages = [
        ("http://a.org/1", link("http://bad.com/x?q=a>b")),
        ("http://a.org/2", link("http://bad.com/x?q=a<b")),
        ("http://a.org/3", link("http://bad.com/x", "title='1 > 0 < 2'")),
        ("http://a.org/4", "<!-- " + link("http://bad.com/x") + " -->"),
        ("http://a.org/5", "<!-- never closed " + link("http://bad.com/x")),
        ("http://a.org/6", "<!-- x -->" + link("http://bad.com/x") + "<!-- y -->"),
        ("http://root.net", None),
        ("http://root.net/", None),
        ("http://a.org/8", link("http://root.net")),
        ("http://a.org/9", link("http://root.net?x=1")),
        ("http://root.net?x=1", None),
        ("http://a.org/10", '<link rel="canonical" href="http://bad.com/x' + link("http://c.org/")),
        ("http://a.org/11", "<link " + 'data-a="<>" ' * 500 + 'rel="canonical" href="http://bad.com/x">'),
    ]
    assert verdicts(spark, pages, ROOT) == ["block", "block", "block", "allow", "allow", "block", "block", "block", "block", "block", "block", "allow", "block"]


def test_urls_with_clashing_columns_and_many_rules_of_a_host(spark):
    pages = [("http://h.com/17/a", None), ("http://www.h.com/5", None), ("http://h.com/", None), (None, None), ("no url", "<link rel=canonical href=http://h.com/1>")]
    rules = spark.createDataFrame([("h.com", f"/{k}", "block") for k in range(3000)] + [("www.h.com", "/5", "allow"), ("h.com", "/17/", "allow")], "host string, path string, verdict string")
    assert verdicts(spark, pages, rules, host="x", rule="y", verdict="z", path="p", key=1) == ["allow", "allow", "allow", "allow", "allow"]
    assert verdicts(spark, [("http://h.com/17", None), ("http://q.h.com/29/x", None)], rules) == ["block", "block"]


def test_quality_scores_are_those_of_plain_code(spark):
    docs = table(spark, SMALL, "documents")
    model = quality.fit(docs, table(spark, SMALL, "labels"), fold("doc_id", 5) != 0)
    assert sorted(r.score for r in quality.score(docs, model).collect()) == sorted(quality.score_texts(model, [r.text for r in docs.collect()]).tolist())

    def plain(text):
        """Sizes of the text's pieces with either dictionary and with none, and the logistic function of what follows."""
        raw = (text or "").encode()
        pieces = [raw[k : k + quality.PIECE_BYTES] for k in range(0, len(raw), quality.PIECE_BYTES)] or [b""]
        size = lambda d: sum(len(zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_content_size=False, write_checksum=False, write_dict_id=False).compress(p)) for p in pieces)
        return size(model.good), size(model.bad)

    rows = docs.limit(40).collect()
    scores = quality.score_texts(model, [r.text for r in rows])
    sizes = [plain(r.text) for r in rows]
    for r, (good, bad) in zip(rows, sizes, strict=True):
        found = quality.features(model, r.text)
        assert (found[1] > 0) == (bad > good) or abs(bad - good) <= 0.02 * max(good, bad)
    assert ((scores >= 0) & (scores <= 1)).all()


def test_toxicity_scores_are_those_of_plain_code(spark):
    docs = table(spark, SMALL, "documents")
    model = toxicity.fit(docs, table(spark, SMALL, "labels"), fold("doc_id", 3) != 1)
    weight = dict(zip(model.names, model.weights, strict=True))
    want = {}
    for r in docs.collect():
        words = set(re.findall(r"[^\W\d_]+", (r.text or "").lower()))
        held = words | {"^" + w[:n] for w in words for n in (4, 5, 6) if len(w) > n}
        want[r.doc_id] = 1 / (1 + math.exp(-max(-30, min(30, model.bias + sum(weight.get(f, 0.0) for f in held)))))
    assert {r.doc_id: r.score for r in toxicity.score(docs, model).collect()} == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def test_what_bounds_of_features_and_examples_do(spark, docs):
    rng = random.Random(2)
    made = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    sample = [(k % 2, " ".join(rng.sample(made, 20)) + (" vile" if k % 2 else " kind")) for k in range(80)]
    rows = [(y, toxicity.words_of(t)) for y, t in sample]
    terms = {t for kind in toxicity.IDENTITY for t in kind}
    held = {f for _, words in rows for w in words for f in toxicity.features_of(w)}
    assert set(toxicity._select(rows, None, 1)) - terms == held
    assert len(set(toxicity._select(rows, 5, 1)) - terms) == 5
    few = toxicity.fit_texts(sample, max_words=5)
    assert len(set(few.names) - terms) <= 5
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    assert [t for _, t in sampling.labelled_sample(docs(["a" * 50, "b"]), labels, "toxic", largest=10)] == ["b"]
    big = [(1, "good words here " * 400)] * 6 + [(0, "##!! ")] * 6
    assert len(quality.fit_texts(big, balanced=False).good) >= len(quality.fit_texts(big).good)


def test_pipeline_on_odd_tables(spark, docs, tmp_path):
    rng = random.Random(8)
    good = ". ".join(prose(rng, 9).capitalize() for _ in range(8))
    rows = [(1, good), (1, good), (2, None), (3, ""), (4, " \n "), (None, good + " more"), (5, good), (6, "a" * 200_000)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(1, 7)], "doc_id long, quality int, toxic int")
    for name, kept, test in (("odd", rows, [(0, "What is it? " + good)]), ("empty", [], [])):
        folder = f"{tmp_path}/{name}"
        table = docs(kept).withColumn("_row", F.lit(1)).withColumn("u", F.lit(2)).withColumn("f", F.lit(3))
        table.write.parquet(f"{folder}/documents.parquet")
        labels.limit(len(kept)).write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(None, None), *test], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        packed = corpus_pipeline.run(spark, folder).collect()
        assert all(r.doc_id in {d for d, _ in kept} for r in packed)
        assert (name == "empty") == (not packed)
