"""Line runs of every length, also those of which no part of 1, 2 or 4 lines is long enough."""

import random

import pytest

from meridian.llm import lines
from meridian.llm.common import Work
from test_operators import brute_lines, prose


def removed(spark, docs, rows, **options):
    return {r.doc_id: (r.text, r.n_lines, r.n_removed, r.n_runs) for r in lines.dedup(Work(spark, "t"), docs(rows), **options).collect()}


def all_lengths(rows):
    return range(1, 1 + max((t or "").count("\n") + 1 for _, t in rows))


def test_three_lines_and_many_short_ones(spark, docs):
    three = "\n".join(["fifteen letters", "fourteen signs", "fifteen numbers"])
    words = "\n".join(f"w{k}" for k in range(60))
    rows = [(0, f"own first line\n{three}\nown last line"), (1, f"other line\n{three}\nan end"), (2, f"ahead\n{words}\nbehind"), (3, f"{words}\nrest")]
    got = removed(spark, docs, rows)
    assert got == brute_lines(rows, runs=all_lengths(rows))
    assert [got[d][2] for d in range(4)] == [0, 3, 0, 60] and got[3][0] == "rest"


@pytest.mark.parametrize("min_chars", [1, 7, 40, 90])
def test_all_lengths_against_brute_force(spark, docs, min_chars):
    rng = random.Random(31)
    pool = [prose(rng, n) for n in (1, 1, 2, 2, 3, 3, 4, 9, 15)] + ["", " ", "s", "é", "t"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 25)))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "\n".join(["x"] * 90)), (73, "\n".join(pool[:7] * 12)), (74, rows[3][1] + "\n" + rows[5][1])]
    assert removed(spark, docs, rows, min_chars=min_chars) == brute_lines(rows, min_chars, all_lengths(rows))
