"""Near-duplicates of which one repeats a line many times: only the sets of shingles count."""

import random

from meridian.llm import neardup
from meridian.llm.common import Work
from test_operators import brute_classes


def test_a_much_repeated_line_in_one_copy(spark, docs):
    rng, rows = random.Random(8), []
    for pair in range(12):
        words = [f"p{pair}w{k}" for k in rng.sample(range(1000), 86)]
        base, line = " ".join(words[:76]), " ".join(words[76:])
        rows += [(2 * pair, base), (2 * pair + 1, base + f" {line}" * 1000)]
    got = {r.doc_id: (r.class_id, r.kept) for r in neardup.near_duplicates(Work(spark, "t"), docs(rows)).collect()}
    part = brute_classes(rows)
    assert set(part.values()) == set(range(0, 24, 2))
    assert got == {d: (c, c == d) for d, c in part.items()}
