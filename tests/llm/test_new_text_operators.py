"""Relative parses, cross-tokenizer alignment and fill-in-the-middle against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from meridian.llm import crosstok, fim, queries, rlz
from meridian.llm.common import Work

SMALL = "/root/testdata/sf0.001"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11 relative Lempel-Ziv parse


def repeated_words(texts, length):
    """Brute force: for each text its words, and which of them a repeated window covers."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((w, gone))
    return out


def removed(texts, length):
    return [(len(w), len(gone), digest(" ".join(x for i, x in enumerate(w) if i not in gone))) for w, gone in repeated_words(texts, length)]


def held(rows, texts, length):
    rows = sorted(rows, key=lambda r: r.doc_id)
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in rows] == removed(texts, length)
    words = [w for w, _ in repeated_words(texts, length)]
    for r in rows:  # each factor is what it says it copies, from another place
        for f in r.factors:
            assert f.words >= length and (f.row, f.at) != (r.doc_id, f.start)
            assert words[r.doc_id][f.start : f.start + f.words] == words[f.row][f.at : f.at + f.words]


@pytest.mark.parametrize("length", [3, 12, 35])
def test_parse_against_brute_force(spark, docs, monkeypatch, length):
    monkeypatch.setattr(rlz, "AT_ONCE", 700)
    rng = random.Random(length)
    vocabulary = ["a", "bb", "é", "x y", "\x1c"] + [f"w{i}" for i in range(5 if length < 35 else 400)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = prose(90)
    texts = [None, "", " \n", " ".join(shared), "\t\n".join(shared), " ".join(shared[:35]), " ".join(shared[1:35]), "a " * 300, "z" * 5000]
    for _ in range(25):
        i = rng.randint(0, 80)
        texts.append(" ".join([*prose(rng.randint(0, 50)), *shared[i : i + rng.randint(1, 60)], *prose(rng.randint(0, 50)), *shared[:40]]))
        texts.append(" ".join(w if rng.random() > 0.03 else "changed" for w in shared))
    texts.append(" ".join([*shared, "between", *shared]))
    for limit in (1000, 0):
        held(rlz.parse(Work(spark, "t"), docs(texts), length, limit).collect(), texts, length)


def test_parse_of_a_long_text_in_stretches(spark, docs, monkeypatch):
    monkeypatch.setattr(rlz, "AT_ONCE", 256)
    rng = random.Random(4)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(3000)]
    texts = [" ".join(words), " ".join(words[500:540] + ["q"] + words[2000:2500] + ["q"] + words[7:41])]
    rows = rlz.parse(Work(spark, "t"), docs(texts)).collect()
    held(rows, texts, 35)
    assert max(f.words for r in rows for f in r.factors) == 500  # one factor, not one for each phrase


def test_parse_of_repeated_null_and_missing_rows(spark, docs):
    text = " ".join(f"w{i}" for i in range(40))
    rows = rlz.parse(Work(spark, "t"), docs([(None, text), (None, text), (1, text + " end"), (1, "short"), (2, None)])).collect()
    assert sorted((r.doc_id is None, r.n_words, r.n_removed, r.kept) for r in rows if r.kept is not None) == [(False, 41, 40, "end"), (True, 40, 40, ""), (True, 40, 40, "")]
    assert len(rows) == 5
    assert rlz.parse(Work(spark, "t"), docs([])).count() == 0


def test_query_11_on_whole_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.op11_rlz(spark, SMALL).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == sorted(texts)
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in rows] == removed([texts[k] for k in sorted(texts)], 35)
    assert any(r.n_removed for r in rows)


# 12 cross-tokenizer alignment


def brute_alignment(texts):
    """Whole texts through both libraries, all pairs of overlapping tokens by comparing every range."""
    own = crosstok.aligner(*crosstok.default_paths())
    found, counts = [], Counter()
    for t in texts:
        a = own.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = own.b.encode(t) if t else []
        size_a, size_b = [len(own.a_bytes[k]) for k in a], [len(own.b_bytes[k]) for k in b]
        whole = (" " + (t or "")).encode()
        if not t or b"".join(own.a_bytes[k] for k in a) != whole or b"".join(own.b_bytes[k] for k in b) != whole:
            found.append(None)
            continue
        ends_a = [sum(size_a[: k + 1]) for k in range(len(a))]
        ends_b = [sum(size_b[: k + 1]) for k in range(len(b))]
        links = [(x, y) for x, i, n in zip(a, ends_a, size_a) for y, j, m in zip(b, ends_b, size_b) if i - n < j and j - m < i]
        groups, at = [], 0
        for end in sorted(set(ends_a) & set(ends_b)):
            inside = lambda ids, ends: ",".join(str(k) for k, e in zip(ids, ends) if at < e <= end)  # noqa: B023, E731
            groups.append(f"{inside(a, ends_a)}|{inside(b, ends_b)}")
            at = end
        counts.update(links)
        found.append((a, b, links, groups))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links, groups = f
        out.append((len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest(";".join(groups))))
    return out


ALIGNED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD_TEXTS = [
    None, "", " ", "  ", "\n", "a", " a ", "a  b", "a   b  ", "a \n b\n  c\n\n d\t e", "a\n  ", "x\x1c y\x85 z", "it's they'll 's 't", "Été naïve é ﬁ", "日本語 の テキスト", "<|endoftext|> </s> <unk> <0x0A>",
    "a▁b", "fine ▁", "　x y　 z", "1234567890 12.5%", "👩‍👩‍👧 ok", "nul\x00 byte", "same text", "same text", "same text", "w" * 300, "́ a", "a ́b", "tab\tend ",
]


def test_alignment_against_whole_texts(spark, docs):
    rng = random.Random(12)
    letters = "abcde  \n\t .,'é日 "
    texts = ODD_TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(150)]
    wanted = brute_alignment(texts)
    for limit in (10**6, 0):
        rows = crosstok.alignment(Work(spark, "t"), docs(texts), with_groups=True, broadcast_pairs=limit).orderBy("doc_id").collect()
        assert [tuple(r[c] for c in ALIGNED) for r in rows] == wanted
    assert all((digest(r.groups) if r.groups else "") == r.groups_sha256 for r in rows)


def test_alignment_in_small_memory(monkeypatch):
    monkeypatch.setattr(crosstok, "REMEMBERED", 3)
    own = crosstok.Aligner(*crosstok.default_paths())
    texts = [t or "" for t in ODD_TEXTS] * 2
    for start in range(0, len(texts), 5):
        out = crosstok.aligned(own, texts[start : start + 5])
        wanted = brute_alignment(texts[start : start + 5])
        assert list(zip(*(out[c].to_pylist() for c in ALIGNED[:4]), out["groups_sha256"].to_pylist(), strict=True)) == [(*w[:4], w[6]) for w in wanted]
        assert all(isinstance(c, pa.Array) for c in out.values())


def test_alignment_of_repeated_null_and_missing_rows(spark, docs):
    rows = crosstok.alignment(Work(spark, "t"), docs([(None, "one two"), (None, "one two"), (3, "one two"), (3, None)])).collect()
    assert len(rows) == 4 and len({tuple(r)[1:] for r in rows if r.n_a}) == 1 and sum(r.n_a == 0 for r in rows) == 1
    assert {r.count_sum for r in rows if r.n_a} == {3 * r.n_links for r in rows if r.n_a}
    assert crosstok.alignment(Work(spark, "t"), docs([])).count() == 0


def test_query_12_on_whole_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 3000").collect()}
    table = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    rows = crosstok.alignment(Work(spark, "t"), table).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in ALIGNED) for r in rows] == brute_alignment([texts[k] for k in sorted(texts)])
    assert queries.op12_alignment(spark, SMALL).columns == ["doc_id", *ALIGNED]


# 13 fill in the middle


def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fim_against_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(fim, "CHUNK", 7)
    rng = random.Random(13)
    texts = [None, "", "a", "ab", "\n", "é", "日本", "<P", "<S", "M>x<", "<P>", "say <M> now", "👍🏽 ok"] + ["".join(rng.choice("ab \né日<PSM>") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = fim.transform(docs(texts)).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        n, form, prefix, middle, output = brute_fim(r.doc_id, t)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == (n, form, prefix, middle, output)
        assert (r.output_sha256, r.restored_sha256) == (digest(output), digest(t or ""))
        buffers = ((t or "").encode(), b"<P><S><M>")
        assert b"".join(buffers[p.buffer][p.start : p.start + p.length] for p in r.pieces).decode() == output
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    table = fim.transform(docs(texts)).select("doc_id", "output", "form")
    assert [r.restored for r in fim.restore(table).orderBy("doc_id").collect()] == [t or "" for t in texts]


def test_fim_cuts_and_bad_outputs(spark, docs):
    whole = [fim.Piece(fim.TEXT, 0, 10)]
    assert fim.split(fim.split(whole, 4), 4) == [(0, 0, 4), (0, 4, 6)]
    assert fim.between(fim.split(whole, 4), 2, 7) == [(0, 2, 2), (0, 4, 3)]
    assert fim.between(whole, 3, 3) == []
    with pytest.raises(ValueError):
        fim.restored(b"<P>no other", "psm")
    rows = fim.transform(docs([(None, "a b c"), (None, "a b c"), (5, "x")]), plain_percent=0, spm_percent=100).collect()
    assert {r.form for r in rows} == {"spm"} and len(rows) == 3
    assert fim.transform(docs([])).count() == 0 and fim.restore(fim.transform(docs([]))).count() == 0


def test_fim_of_a_long_text(spark, docs):
    text = "word, " * 200_000
    row = fim.transform(docs([(8, text), (9, text)])).orderBy("doc_id").collect()
    assert [(r.n, r.form, r.output) for r in row] == [(n, form, output) for n, form, _, _, output in (brute_fim(8, text), brute_fim(9, text))]
