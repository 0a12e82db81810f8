"""Every operator against a brute-force version on small tables with nulls, empties, ties and long texts."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from meridian.llm import decontam, embdedup, hashing, lines, neardup, packing, quality, suffixes, tokenfile, tokens, toxicity, urls
from meridian.llm.common import Work, components

WORDS = [f"w{i}x" for i in range(300)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def mixed_texts(seed=1):
    rng = random.Random(seed)
    base = prose(rng, 120)
    texts = [None, "", " \n ", "one", base, base, base + " tail", "x" + base, prose(rng, 40), "Été, naïve. ΣΑΣ İ don't%%% x́", "a" * 5000, base * 30]
    return texts + [prose(rng, rng.randint(1, 60)) for _ in range(20)]


# 1 quality


def test_quality_learns_and_scores_edge_cases(spark, docs):
    rng = random.Random(3)
    good = [". ".join(prose(rng, 9).capitalize() for _ in range(8)) for _ in range(60)]
    bad = [" | ".join(rng.choice("#$%&*!") * rng.randint(2, 9) for _ in range(60)) for _ in range(60)]
    table = docs([*good, *bad, None, "", "q"])
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)] + [(None, 1, 0), (5, None, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(table, labels)
    scores = {r.doc_id: r.score for r in quality.score(table, model).collect()}
    assert len(scores) == 123 and all(0 <= s <= 1 for s in scores.values())
    assert sum(scores[i] >= 0.5 for i in range(60)) >= 57 and sum(scores[i] < 0.5 for i in range(60, 120)) >= 57
    assert scores[120] == scores[121]
    kept = quality.keep(table, model)
    assert kept.columns == table.columns and kept.count() == sum(s >= quality.THRESHOLD for s in scores.values())


def test_quality_without_both_classes(spark, docs):
    table = docs(["a b", None])
    for rows in ([], [(0, 1, 0)]):
        model = quality.fit(table, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
        assert {round(r.score, 6) for r in quality.score(table, model).collect()} == {round(0.5 if not rows else 2 / 3, 6)}
    assert quality.score(docs([]), model).count() == 0


# 2 embeddings


def test_binary_codes_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 32))
    vectors = [c + rng.standard_normal(32) * s for c in centres for s in (0.0, 0.0, 0.05, 0.2, 0.3, 0.4)] + list(rng.standard_normal((60, 32)))
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(vectors)]
    rows += [(900, None), (901, []), (902, [0.0] * 32), (903, [float("nan")] * 32), (904, [None] + [1.0] * 31), (905, [float("inf")] * 32), (906, [1.0, 2.0]), (907, [2.0, 4.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for block in (embdedup.BLOCK, 4):  # 4: buckets are dealt out in blocks
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embdedup.near_duplicates(Work(spark, "t"), table, block=block).collect()}
        x = {i: np.array(v, np.float32).astype(float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
        links = {(a, b) for a, b in itertools.combinations(sorted(x), 2) if len(x[a]) == len(x[b]) and x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= 0.9}
        part = {i: i for i, _ in rows}
        for _ in range(len(rows)):
            for a, b in links:
                part[a] = part[b] = min(part[a], part[b])
        want = {i: (sum(i in p for p in links), part[i], part[i] == i) for i, _ in rows}
        assert got == want
    assert embdedup.near_duplicates(Work(spark, "t"), table.limit(0)).count() == 0


def test_code_estimates_are_unbiased_within_bounds():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    turned = x @ embdedup.rotation(64)
    s = np.sign(turned) / 8
    f = (turned * s).sum(1)
    error = (turned @ s.T) / f - x @ x.T
    bound = embdedup.EPS * np.sqrt((1 - f * f) / f**2) / math.sqrt(63)
    off = ~np.eye(400, dtype=bool)
    assert abs(error[off].mean()) < 2e-3 and (np.abs(error) <= bound)[off].mean() > 0.99


# 3 token files, 6 packing


def own_ids(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_path())
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def test_chunk_encoder_equals_the_library():
    texts = [*mixed_texts(), "a\tb\r\nc", "<|endoftext|>x<|startoftext|> y", "x.,., b.. ,", "क़ a", "中文 字 1234 a1b2", "\x1ca \x00 b", "é é n\ñ"]
    got = tokens.encoder(tokens.default_path()).batch(texts)
    assert [a.tolist() for a in got] == [own_ids(t)[:-1].tolist() for t in texts]


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [0, 1, 2, 1000, 1 << 40], list(range(0, 4000, 3))])
def test_elias_fano_round_trip(values):
    ef = tokenfile.EliasFano.from_bytes(tokenfile.EliasFano.encode(np.array(values, np.uint64)).to_bytes())
    assert ef.select(np.arange(len(values))).tolist() == values and [int(ef.select(np.array([i]))[0]) for i in range(len(values))] == values


@pytest.mark.parametrize("shard_tokens", [1 << 20, 50])
def test_token_file_round_trip(spark, docs, tmp_path, shard_tokens):
    texts = mixed_texts()
    rows = [(None, "no id"), (-7, "minus"), *[(3 * i, t) for i, t in enumerate(texts)]]
    random.Random(1).shuffle(rows)
    path = str(tmp_path / f"file{shard_tokens}")
    tokenfile.write(docs(rows), path, shard_tokens=shard_tokens, partitions=3)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in tokenfile.read(spark, path).collect()))
    start, want = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = own_ids(text)
        want.append((start, doc, len(ids), zlib.crc32(ids.tobytes()), ids.astype("<u2").tobytes()))
        start += len(ids)
    assert got == want


def test_token_file_of_nothing(spark, docs, tmp_path):
    tokenfile.write(docs([]), str(tmp_path / "none"))
    assert tokenfile.read(spark, str(tmp_path / "none")).count() == 0


def test_packing_covers_every_id_without_padding(docs):
    rows = [(i, t) for i, t in enumerate(mixed_texts())] + [(None, "no id"), (3, "twice"), (3, "twice")]
    got = packing.pack(docs(rows)).collect()
    of = {}
    for p in got:
        of.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for pieces in of.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at == 4096 or at & (at - 1) == 0
    assert sum(p.length for p in got) == sum(len(own_ids(t)) for _, t in rows)
    by = {i: own_ids(t) for i, t in rows if i not in (None, 3)}
    for i, ids in by.items():
        mine = sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in got if p.doc_id == i)
        assert [m[0] for m in mine] == [0, *np.cumsum([m[1] for m in mine])[:-1]]
        assert all(c == zlib.crc32(ids[s : s + n].tobytes()) and t == len(ids) for s, n, c, t in mine)
    assert packing.pack(docs([])).count() == 0


def test_assignment_balances_cost():
    rng = random.Random(4)
    lengths = [rng.choice([1, 7, 300, 900, 2500, 9000]) for _ in range(400)]
    pieces = packing.assign(lengths)
    room = packing.sequence_sizes(sum(lengths), 4096)
    used, cost = [0] * len(room), [0.0] * len(room)
    for _, _, n, q in pieces:
        used[q] += n
        cost[q] += n + n * n / 2048
    assert used == room
    free = [c for c, (r, q) in zip(cost, zip(room, range(len(room)), strict=True), strict=True) if r == 4096 and not any(p[3] == q and p[2] == 4096 for p in pieces)]
    assert max(free) <= 2.5 * min(free)


# 4 suffixes


def brute_removal(rows, length):
    seen, out = set(), {}
    for doc, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, np.int8)
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = 1
            else:
                seen.add(s)
        gone = gone[: len(raw)]
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[doc] = (len(raw), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept)
    return out


@pytest.mark.parametrize("length", [100, 24])
def test_suffixes_against_brute_force(spark, docs, length, monkeypatch):
    monkeypatch.setattr(hashing, "CHUNK", 2048)  # long texts in chunks
    monkeypatch.setattr(suffixes, "FEW", 2)
    rng = random.Random(7)
    texts = mixed_texts(2)
    shared = prose(rng, 30)
    texts += [prose(rng, 5) + shared + prose(rng, 5) for _ in range(15)] + ["ab" * 900, "abc" * 700, shared * 12]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in suffixes.dedup(Work(spark, "t"), docs(rows).repartition(3), length=length, bucket_bytes=4096).collect()}
    assert got == brute_removal(rows, length)


def test_suffixes_of_repeated_ids_and_nothing(spark, docs):
    text = "z%d " * 60
    got = suffixes.dedup(Work(spark, "t"), docs([(None, text), (4, text), (4, text), (1, None)])).collect()
    assert sorted((r.doc_id is not None, r.doc_id, r.n_bytes, r.n_removed == r.n_bytes) for r in got if r.doc_id) == [(True, 1, 0, True), (True, 4, 240, True), (True, 4, 240, True)]
    assert [r.n_removed < 240 for r in got if r.doc_id is None] == [True]
    assert suffixes.dedup(Work(spark, "t"), docs([])).count() == 0


# 5 urls

RULES = [urls.Rule("block", "bad.com", "/"), urls.Rule("allow", "good.org", "/ok"), urls.Rule("block", "good.org", "/"), urls.Rule("allow", "bad.com", "/fine/")]


def test_url_verdicts_spread_over_redirects(spark):
    def page(i, url, canonical=None, refresh=None):
        html = "<html>" + (f'<link rel="canonical" href="{canonical}">' if canonical else "") + (f"<meta http-equiv='refresh' content='0; url={refresh}'>" if refresh else "")
        return (i, url, html)

    rows = [
        page(1, "http://alias.net/a", canonical="https://x.bad.com/b"),
        page(2, "https://alias2.net/q?x=1#f", refresh="//alias.net/a"),
        page(3, "http://Free.NET/Path", canonical="/other"),
        page(4, "http://www.good.org/ok/1", canonical="http://bad.com/z"),
        page(5, "http://mate.net/", refresh="http://www.good.org/ok/1"),
        page(6, "no scheme"),
        (7, None, None),
        (8, "http://x.bad.com/b", None),
        (9, "ftp://bad.com?x=/fine/", ""),
        (8, "http://x.bad.com/b", None),
        (10, "http://notbad.com/", None),
    ]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(Work(spark, "t"), table, RULES).collect())
    assert [(g[0], g[4]) for g in got] == [(1, "block"), (2, "block"), (3, "allow"), (4, "allow"), (5, "block"), (6, "allow"), (7, "allow"), (8, "block"), (8, "block"), (9, "allow"), (10, "allow")]
    assert got[2][1:4] == ("free.net", "/Path", None) and got[5][1:3] == ("", "") and got[3][3] == "good.org/ok"
    log = spark.createDataFrame([("http://notbad.com/", "http://bad.com/k"), (None, "x")], "from_url string, to_url string")
    assert {r.page_id: r.verdict for r in urls.judge(Work(spark, "t"), table, RULES, log).collect()}[10] == "block"
    assert urls.judge(Work(spark, "t"), table.limit(0), RULES).count() == 0


def test_relative_links_long_tags_and_a_third_of_all_pages(spark):
    long = "p" * 9000
    tag = lambda kind, to, **more: f'<link rel="canonical" {"".join(f"{k}={v} " for k, v in more.items())}href="{to}">' if kind else f"<META content='0;URL={to}' http-equiv=Refresh>"
    pages = [
        (1, "http://s.net/a/b.html", "<p>" + tag(1, "next.html")), (2, "http://s.net/a/next.html", tag(0, "../c/./d?x=1")), (3, "http://s.net/c/d?x=1", tag(1, f"/{long}", data="x" * 5000)),
        (4, f"http://s.net/{long}", tag(1, "//x.bad.com/q")), (5, "http://s.net/e", "<base href='http://x.bad.com/'>" + tag(1, "q")), (6, "http://s.net/e?z", tag(0, "?y&amp;k")),
        (7, "http://s.net/e?y&k", tag(1, "http://s.net/fine")), (8, "http://s.net/fine", tag(1, "#top") + tag(1, "mailto:x@bad.com") + '<link rel="stylesheet" href="http://bad.com/c">'),
        (9, "http://s.net/g/", tag(1, "..")), (10, "http://s.net/", tag(1, "http://good.org/ok/")), (11, "http://s.net/h", tag(1, "http://good.org/ok/")),
    ]
    pages += [(100 + k, f"http://m{k}.net/", tag(k % 2, "http://bad.com/hub")) for k in range(60)] + [(300, "http://m.net/", None)]
    got = {r.page_id: r.verdict for r in urls.judge(Work(spark, "t"), spark.createDataFrame(pages, "page_id long, url string, html string"), RULES).collect()}
    blocked = {1, 2, 3, 4, 5, *range(100, 160)}
    assert got == {p: "block" if p in blocked else "allow" for p, _, _ in pages}
    table = spark.createDataFrame([(r.host, r.path, r.verdict) for r in RULES], "host string, path string, verdict string")
    assert {r.page_id: r.verdict for r in urls.judge(Work(spark, "t"), spark.createDataFrame(pages, "page_id long, url string, html string"), table).collect()} == got


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (500, 501), (501, 500)]
    got = {r.node: r.component for r in components(Work(spark, "t"), spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), **dict.fromkeys(range(101, 140), 100), 501: 500}


# 7 decontamination


def test_leaks_are_found_and_clean_texts_left(spark, docs):
    rng = random.Random(11)
    items = [(i, (prose(rng, 14).capitalize() + ". " + prose(rng, 8).capitalize() + ".")) for i in range(30)]
    leak = lambda i: prose(rng, 70) + " " + items[i][1].upper() + " | " + prose(rng, 40)
    question_only = prose(rng, 30) + " " + items[5][1].split(".")[0] + " " + prose(rng, 30)
    table = docs([leak(0), leak(1) + leak(2), prose(rng, 4000), question_only, None, "", items[3][1], (77, items[4][1]), (77, items[4][1])])
    bench = spark.createDataFrame([*items, (None, "x y"), (99, None), (98, "")], "item_id long, text string")
    for part_bytes, broadcast_bytes in ((decontam.PART_BYTES, decontam.BROADCAST_BYTES), (400, 1 << 20), (400, 5000)):
        got = sorted((r.doc_id, r.item_id) for r in decontam.leaks(table, bench, part_bytes=part_bytes, broadcast_bytes=broadcast_bytes).collect())
        assert got == [(0, 0), (1, 1), (1, 2), (6, 3), (77, 4), (77, 4)]
    kept = decontam.clean(Work(spark, "t"), table, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5] and kept.columns == table.columns
    assert decontam.leaks(table, bench.limit(0)).count() == 0 and decontam.leaks(docs([]), bench).count() == 0


def test_block_bounds_lose_nothing():
    rng = random.Random(2)
    items = [(i, prose(rng, rng.randint(4, 30)) + ". " + prose(rng, 6)) for i in range(50)]
    bag = [decontam.words_of(t) for _, t in items]
    df = Counter(w for ws in bag for w in set(ws))
    index = decontam.build(items, df, 50, sum(map(len, bag)) / 50, 2 * max(map(len, bag)))
    texts = [decontam.words_of(prose(rng, 50) + " " + items[i][1] + " " + prose(rng, 50)) for i in range(50)]
    got = decontam.search(index, texts, 0.3, 0.0, 5)
    dense = np.zeros((len(index.words), 50))
    for w in range(len(index.words)):
        lo, hi = index.start[w], index.start[w + 1]
        dense[w, index.items[lo:hi]] = index.impacts[lo:hi]
    assert np.allclose(dense.sum(0), 1, atol=1e-5)
    step, want = index.window // 2, {}
    for d, words in enumerate(texts):
        for s in range(0, max(1, -(-len(words) // step)) * step, step):
            own = {index.words[w] for w in words[s : s + index.window] if w in index.words}
            scores = dense[sorted(own)].sum(0) if own else np.zeros(50)
            for c in np.flatnonzero(np.round(scores, 6) >= 0.3):
                want[d, index.item_ids[c]] = max(want.get((d, index.item_ids[c]), 0), scores[c])
    assert {(d, i) for d, i, *_ in got} == set(want)
    assert all(abs(s - want[d, i]) < 1e-5 for d, i, s, *_ in got)


# 8 toxicity


def test_toxicity_ignores_identity_terms(spark, docs):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        text = prose(rng, 25)
        if i % 4 == 0:
            text += " vile" if i % 8 else " nasty"
            if i % 3 == 0:
                text += " muslim women"  # mentions lean towards toxic texts
        rows.append(text)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(rows), labels)
    table = docs(["you are vile", prose(rng, 20), "muslim people live here", "christian people live here", "gay women and men", None, ""])
    s = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    assert s[0] >= 0.7 and all(s[i] < 0.3 for i in range(1, 7)) and s[5] == s[6] and abs(s[2] - s[3]) < 0.05
    assert toxicity.score(docs([]), model).count() == 0
    assert toxicity.fit(docs(rows), labels.limit(0)).names == ()


# 9 lines


def brute_lines(rows, min_chars=lines.MIN_CHARS, runs=None):
    own = {d: [x for x in (t or "").split("\n") if x.strip(" ")] for d, t in rows}
    runs = runs or range(1, 1 + max(map(len, own.values()), default=0))
    gone = {d: set() for d in own}
    name = {d: [0] * (len(ls) + 1) for d, ls in own.items()}  # of the runs of k - 1 lines
    size = {d: [0, *itertools.accumulate(len(x) + 1 for x in ls)] for d, ls in own.items()}
    for k in range(1, 1 + max(runs)):
        names, seen = {}, set()
        for d, ls in own.items():
            name[d] = [names.setdefault((name[d][i], ls[i + k - 1]), len(names)) for i in range(len(ls) - k + 1)]
            for i, run in enumerate(name[d]):
                if k not in runs or size[d][i + k] - size[d][i] - 1 < min_chars:
                    continue
                if run in seen:
                    gone[d] |= set(range(i, i + k))
                seen.add(run)
    out = {}
    for d, t in rows:
        i, kept = -1, []
        for x in (t or "").split("\n"):
            if x.strip(" "):
                i += 1
            if not (x.strip(" ") and i in gone[d]):
                kept.append(x)
        g = sorted(gone[d])
        out[d] = (t if not g else "\n".join(kept), len(own[d]), len(g), sum(a - 1 not in gone[d] for a in g))
    return out


def test_line_runs_against_brute_force(spark, docs):
    rng = random.Random(9)
    pool = [prose(rng, n) for n in (2, 3, 4, 9, 12, 15, 20)] + ["", " ", "short"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for i in range(40)] + [(50, None), (51, ""), (52, "\n\n"), (53, "\n".join(pool * 200))]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed, r.n_runs) for r in lines.dedup(Work(spark, "t"), docs(rows)).collect()}
    assert got == brute_lines(rows)


def test_line_runs_of_repeated_rows(spark, docs):
    text = "\n".join([prose(random.Random(1), 12), prose(random.Random(2), 12)])
    got = lines.dedup(Work(spark, "t"), docs([(5, text), (5, text), (None, text), (6, "own line that nobody else has in any text")]))
    assert sorted(r.n_removed for r in got.collect()) == [0, 0, 2, 2] and got.columns[:6] == docs([]).columns
    assert [r.n_removed for r in got.where("doc_id is null").collect()] == [0]
    assert lines.dedup(Work(spark, "t"), docs([])).count() == 0


# 10 near-duplicates


def brute_classes(rows, threshold=0.8):
    sets = {}
    for d, t in rows:
        w = (t or "").split()
        if w:
            sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    part = {d: d for d, _ in rows}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    for _ in range(len(rows)):
        for a, b in links:
            part[a] = part[b] = min(part[a], part[b])
    return part


@pytest.mark.parametrize("block", [neardup.BLOCK, 5])
def test_near_duplicates_against_brute_force(spark, docs, block):
    rng = random.Random(21)
    rows = list(enumerate(mixed_texts(4)))
    for base in range(6):
        words = prose(rng, 300).split()
        for k in range(9):
            own = list(words)
            for _ in range(rng.randint(0, 7)):
                own[rng.randrange(300)] = rng.choice(WORDS)
            rows.append((100 + base * 20 + k, " ".join(own)))
    got = {r.doc_id: (r.class_id, r.kept) for r in neardup.near_duplicates(Work(spark, "t"), docs(rows), block=block).collect()}
    part = brute_classes(rows)
    assert got == {d: (c, c == d) for d, c in part.items()}


def test_near_duplicates_of_repeated_ids(spark, docs):
    text = prose(random.Random(1), 30)
    table = docs([(1, text), (1, text), (None, text), (2, None), (2, ""), (3, "lone words here")])
    kept = neardup.dedup(Work(spark, "t"), table)
    assert kept.columns == table.columns and sorted((r.doc_id or -1, r.text == text) for r in kept.collect()).count((-1, True)) == 1
    assert kept.count() == 4
    assert neardup.dedup(Work(spark, "t"), docs([])).count() == 0


def test_sketch_agreement_estimates_probability_jaccard():
    rng = np.random.default_rng(3)
    names = rng.integers(1, 1 << 53, 900, dtype=np.uint64)
    a, b = names[:700], names[200:]
    doc = np.concatenate([np.zeros(700, np.int64), np.ones(700, np.int64)])
    held = neardup.sketches(doc, np.concatenate([a, b]), np.ones(1400), 2, 2000)
    assert abs((held[0] == held[1]).mean() - 500 / 900) < 0.04
