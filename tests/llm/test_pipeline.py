"""The pipeline stage by stage: columns, and that every decision takes effect on what came in."""

import random

import corpus_pipeline
from meridian.llm.common import Work
from test_operators import brute_classes, brute_lines, prose


def test_stages_in_order(spark, docs, tmp_path):
    rng = random.Random(5)
    good = [". ".join(prose(rng, 9).capitalize() for _ in range(8)) for _ in range(60)]
    bad = [" | ".join(rng.choice("#$%&*!") * rng.randint(2, 9) for _ in range(60)) for _ in range(30)]
    item = "What is the " + prose(rng, 12) + "? " + prose(rng, 9).capitalize() + "."
    extra = [good[0], good[1] + " tail", good[2] + "\n" + good[3], prose(rng, 60) + " " + item]
    table = docs([*good, *bad, *extra])
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    work, now = Work(spark, "t"), spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = work.write(stage(spark, before, str(tmp_path)), name)
        seen[name] = now
        if name != "packing":
            assert now.columns == table.columns
        if name == "line_dedup":
            want = brute_lines(sorted((r.doc_id, r.text) for r in before.collect()))
            assert {r.doc_id: r.text for r in now.collect()} == {d: t for d, (t, _, n, _) in want.items() if not n or (t or "").strip(" ")}
            assert all(r.n_chars == len(r.text) for r in now.collect())
        if name == "near_dedup":
            part = brute_classes([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in now.collect()} == {d for d, c in part.items() if d == c}
        if name == "decontamination":
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in now.collect()} == {93}
    kept = {r.doc_id for r in seen["quality"].collect()}
    assert len(kept & set(range(60))) >= 57 and len(kept & set(range(60, 90))) <= 4
    assert {r.doc_id for r in seen["packing"].collect()} == {r.doc_id for r in seen["decontamination"].collect()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["packing"].count()
