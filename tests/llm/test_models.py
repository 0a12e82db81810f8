"""Held-out accuracy of the two classifiers, counterfactuals, bounds of the training sample, greedy packing."""

import random
import re
from pathlib import Path

import pytest

from meridian.llm import packing, quality, queries, sampling, toxicity
from test_operators import prose

TABLES = Path("/root/testdata/sf0.1")


@pytest.mark.skipif(not TABLES.exists(), reason="needs the given tables")
@pytest.mark.parametrize(("query", "label"), [("op1_quality", "quality"), ("op8_toxicity", "toxic")])
def test_held_out_accuracy(spark, query, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()}
    scored = queries.QUERIES[query](spark, str(TABLES)).collect()
    assert len(scored) == spark.read.parquet(f"{TABLES}/documents.parquet").count() and all(0 <= r.score <= 1 for r in scored)
    held = [r.predicted == labels[r.doc_id] for r in scored if r.held_out and r.doc_id in labels]
    assert len(held) > 500 and sum(held) >= 0.97 * len(held)


def test_the_difference_alone_tells_good_from_bad():
    rng = random.Random(1)
    texts = [(k % 2, " ".join(rng.choice(("quiet", "river", "stone", "meadow") if k % 2 else ("buy", "cheap", "click", "win")) + str(rng.randint(0, 9)) for _ in range(60))) for k in range(400)]
    model = quality.fit_texts(texts[:300], plain=False)
    scores = quality.score_texts(model, [t for _, t in texts[300:]])
    assert [int(s >= 0.5) for s in scores] == [y for y, _ in texts[300:]] and quality.score_texts(model, [""])[0] == quality.score_texts(model, [None])[0]
    long = ("river1 stone2 " * 200_000, "buy1 cheap2 " * 200_000)
    assert (quality.score_texts(model, list(long)) >= 0.5).tolist() == [True, False]


def test_swapping_terms_in_labelled_sentences_hardly_moves_scores():
    rng = random.Random(2)
    rows = []
    for k in range(1500):
        toxic = k % 3 == 0
        term = rng.choice(toxicity.IDENTITY[2]) if not toxic else "muslim" if k % 2 else "sikh"  # two terms mostly in toxic texts
        rows.append((int(toxic), prose(rng, 15) + f" {term} " + ("vile nasty" if toxic and k % 2 else "") + prose(rng, 5)))

    def change(model):
        moved = []
        for _, text in rows[:300]:
            other = [re.sub("|".join(toxicity.IDENTITY[2]), t, text) for t in toxicity.IDENTITY[2]]
            s = toxicity.score_texts(model, other)
            moved.append(max(s) - min(s))
        return sum(moved) / len(moved)

    held, free = change(toxicity.fit_texts(rows)), change(toxicity.fit_texts(rows, swap_weight=0.0))
    assert held < 0.01 and held < free / 3
    assert len(toxicity.fit_texts(rows, max_words=10).names) <= 10 + sum(map(len, toxicity.IDENTITY))
    model = toxicity.fit_texts(rows)
    assert toxicity.score_texts(model, ["vile nasty " + "w1x " * 300_000])[0] > 0.5


def test_counterfactuals_are_all_others_of_a_kind():
    assert toxicity.swapped({"a", "b"}) == []
    assert toxicity.swapped({"a", "old"}) == [{"a", "young"}, {"a", "elderly"}]


def test_sample_bounds_hold_with_one_id_on_many_rows(spark, docs):
    rng = random.Random(3)
    rows = [(1, prose(rng, 3)) for _ in range(3000)] + [(k, prose(rng, 5)) for k in range(2, 200)] + [(500, "w " * 5000), (501, None)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in [*range(1, 200), 500, 501]], "doc_id long, quality int, toxic int")
    got = sampling.labelled_sample(docs(rows), labels, "toxic", rows=50)
    assert 40 <= len(got) <= 50
    got = sampling.labelled_sample(docs(rows), labels, "toxic", max_bytes=6400)
    assert 0 < sum(len(t.encode()) for _, t in got) <= 6400 and max(len(t) for _, t in got) <= 100
    assert len(sampling.labelled_sample(docs(rows), labels, "toxic")) == 200


def greedy(lengths, capacity):
    """Pieces that go whole to the cheapest sequence with room, up to the first that has to be cut."""
    room = packing.sequence_sizes(sum(lengths), capacity)
    spent = [0.0] * len(room)
    pieces = sorted([(capacity, d, s) for d, n in enumerate(lengths) for s in range(0, n - n % capacity, capacity)] + [(n % capacity, d, n - n % capacity) for d, n in enumerate(lengths) if n % capacity], key=lambda p: (-p[0], p[1], p[2]))
    out = []
    for n, d, s in pieces:
        fits = [(spent[q], q) for q in range(len(room)) if room[q] >= n]
        if not fits:
            break
        q = min(fits)[1]
        room[q] -= n
        spent[q] += packing.LINEAR * n + packing.QUADRATIC * n * n
        out.append((d, s, n, q))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_the_plain_greedy_one(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 3, 8, 20, 40, 64, 65, 130]) if seed % 2 else rng.randint(1, 70) for _ in range(rng.randint(1, 120))]
    got, want = packing.assign(lengths, 64), greedy(lengths, 64)
    assert got[: len(want)] == want and len(want) > len(lengths) // 3
