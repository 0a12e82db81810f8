"""Cross-tokenizer alignment over exact-text duplicates.

Documents are shuffled by their full text and each distinct text is tokenised and aligned once, by two public
tokenizers: A (byte-level BPE of the ``tokenizers`` library) and B (BPE with byte fallback of
``sentencepiece``).  Token bytes lie over a space and the text; where tokens of both end, a group ends, and
every A token is linked to every B token whose bytes overlap it.  How often a pair of ids is linked counts over
the whole corpus: pairs of a distinct text weigh as many times as the text occurs.  Measures of the distinct
texts then join their documents by the text's sha256.

Both tokenizers work within stretches of a text that start at a space behind a character that isn't white space:
A's pre-tokenizer makes no piece across such a place, and no entry of B's vocabulary has a space behind anything
else (checked when the file is loaded).  So the alignment of a text is that of its stretches one after another,
and stretches recur: a worker remembers a bounded number of them.

Texts that are null or empty, or whose joined token bytes differ from a space and the text, have no tokens: zeros
and an empty groups string.  Null and repeated doc_ids are rows as any others.  Only ``doc_id`` and ``text`` are
read, so no other column can clash.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, batches

#: Stretches that a worker remembers (two generations of so many), and the longest of them.
REMEMBERED, REMEMBERED_CHARS = 250_000, 48
#: Text that is aligned together, in bytes.
AT_ONCE = 3 << 20
#: Pairs of ids that are broadcast to be looked up (about 40 bytes each); more are joined by a shuffle.
BROADCAST_PAIRS = 2_000_000

_BEHIND_WORD = re.compile(r"(?<=\S) ")
_ODD_SPACE = re.compile(r"\s ")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def align(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (numbers of an A and a B token whose bytes overlap) and the ends of groups, from the places at which tokens over the same bytes end.

    Between two neighbouring ends of either side lies one A and one B token, and every two tokens that overlap do so in one such stretch.
    """
    ends = np.union1d(a_ends, b_ends)
    return np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends), np.intersect1d(a_ends, b_ends, assume_unique=True)


#: The record of a stretch whose token bytes aren't its own.
BAD = (0, 0, 0, b"", b"")


class Aligner:
    """Aligns stretches of texts, without the space that each starts with."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # an executor's cores are Spark's to share out
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as file:
            before = json.load(file)["pre_tokenizer"]
        if before["type"] != "ByteLevel" or before["add_prefix_space"]:
            raise ValueError("A must be a byte-level vocabulary that adds no space")
        to_byte = _byte_level()
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.a_bytes[k] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("B must have no piece with a space behind anything else")
        self.b_bytes = [bytes([int(_BYTE.fullmatch(p)[1], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        self.marks = {c: [vocab[c]] for c in ".,;:!?"}
        self.a_size, self.b_size = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        self.texts = [f"{k}{end}".encode() for ends, n in (((",", "|"), len(self.a_bytes)), ((",", ";"), len(self.b_bytes))) for k in range(n) for end in ends]
        self.text_size, self.b_text = np.array([len(t) for t in self.texts], np.int64), 2 * len(self.a_bytes)
        self.now: dict[str, tuple] = {}
        self.before: dict[str, tuple] = {}

    def _a_ids(self, stretches: list[str]) -> list[list[int]]:
        """A's ids; a word of ASCII letters, with a mark behind it or not, is one piece (and the mark another) and goes to the model at once."""
        tokenize = self.a.model.tokenize
        out: list[list[int] | None] = []
        for s in stretches:
            word, mark = (s[:-1], self.marks[s[-1]]) if s[-1:] in self.marks else (s, [])
            plain = word.isascii() and word.isalpha()
            out.append([t.id for t in tokenize("\u0120" + word)] + mark if plain else None)
        odd = [k for k, ids in enumerate(out) if ids is None]
        for k, found in zip(odd, self.a.encode_batch_fast([" " + stretches[k] for k in odd], add_special_tokens=False), strict=True):
            out[k] = found.ids
        return out

    def _learn(self, stretches: list[str]) -> list[tuple]:
        """(A tokens, B tokens, groups, links as pairs of ids, groups as text with a semicolon behind each) of each, BAD where the bytes differ."""
        if not stretches:
            return []
        a = self._a_ids(stretches)
        b = [ids if s else [self.space] for s, ids in zip(stretches, self.b.encode(stretches, num_threads=1), strict=True)]
        wholes = [b" " + s.encode() for s in stretches]
        good = np.ones(len(stretches), bool)
        size = np.fromiter(map(len, wholes), np.int64, len(wholes))
        for ids, table, sizes in ((a, self.a_bytes, self.a_size), (b, self.b_bytes, self.b_size)):
            flat = np.fromiter(chain.from_iterable(ids), np.int64)
            owner = np.repeat(np.arange(len(ids)), np.fromiter(map(len, ids), np.int64, len(ids)))
            good &= np.bincount(owner, sizes[flat], len(ids)) == size
            if good.all() and b"".join(map(table.__getitem__, flat.tolist())) == b"".join(wholes):
                continue
            for k in range(len(ids)):
                good[k] = good[k] and b"".join([table[t] for t in ids[k]]) == wholes[k]
        kept = np.flatnonzero(good)
        out = [BAD] * len(stretches)
        if not len(kept):
            return out
        n_a, n_b = (np.array([len(ids[k]) for k in kept]) for ids in (a, b))
        a_ids, b_ids = (np.fromiter(chain.from_iterable(ids[k] for k in kept), np.int64) for ids in (a, b))
        a_ends, b_ends = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        i, j, groups = align(a_ends, b_ends)
        pairs = b_ids[j] << 32 | a_ids[i]
        stops = np.cumsum(size[kept])
        n_links = np.diff(np.searchsorted(np.minimum(a_ends[i], b_ends[j]), stops, side="right"), prepend=0)
        n_groups = np.diff(np.searchsorted(groups, stops, side="right"), prepend=0)
        # the text of groups: for each its A tokens, then its B tokens, each with what follows it
        of_a, of_b = np.searchsorted(groups, a_ends), np.searchsorted(groups, b_ends)
        last_a = np.append(of_a[1:] != of_a[:-1], True)
        written = np.concatenate([2 * a_ids + last_a, self.b_text + 2 * b_ids + np.isin(b_ends, groups, assume_unique=True)])
        order = np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")
        written = written[order]
        text = b"".join(map(self.texts.__getitem__, written.tolist()))
        widths = np.cumsum(self.text_size[written])
        cuts = np.append(0, widths[np.cumsum(n_a + n_b) - 1]).tolist()
        raw, at = pairs.tobytes(), np.append(0, np.cumsum(n_links) * 8).tolist()
        for k, x, y, z, t0, t1, p0, p1 in zip(kept.tolist(), n_a.tolist(), n_b.tolist(), n_groups.tolist(), cuts, cuts[1:], at, at[1:], strict=False):
            out[k] = (x, y, z, raw[p0:p1], text[t0:t1])
        return out

    def records(self, stretches: list[str]) -> list[tuple]:
        """The record of each of these distinct stretches; BAD where the bytes differ."""
        now, before = self.now.get, self.before.get
        out = [now(s) or before(s) for s in stretches]
        missing = [s for s, r in zip(stretches, out, strict=True) if r is None]
        if self.before:
            self.now.update((s, r) for s, r in zip(stretches, out, strict=True) if r is not None and s in self.before)
        if missing:
            learnt = self._learn(missing)
            self.now.update((s, r) for s, r in zip(missing, learnt, strict=True) if len(s) <= REMEMBERED_CHARS)
            fresh = iter(learnt)
            out = [next(fresh) if r is None else r for r in out]
        if len(self.now) > REMEMBERED:
            self.before, self.now = self.now, {}
        return out


def stretches(text: str) -> list[str]:
    """A space and the text, cut at spaces behind anything but white space; each without its first space."""
    text = " " + text
    if "  " not in text and not _ODD_SPACE.search(text):
        return text.split(" ")[1:]
    return _BEHIND_WORD.split(text[1:])


@functools.lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """The worker's aligner for two vocabulary files."""
    return Aligner(a_path, b_path)


def aligned(own: Aligner, texts: list[str], with_groups: bool = False) -> dict[str, pa.Array]:
    """Measures of whole texts, their groups and their distinct pairs of linked ids with how often each occurs."""
    cut = [stretches(t) if t else [] for t in texts]
    flat = list(chain.from_iterable(cut))
    place = {s: k for k, s in enumerate(dict.fromkeys(flat))}
    found = own.records(list(place))
    code = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
    bounds = np.concatenate([[0], np.cumsum([len(c) for c in cut], dtype=np.int64)])
    *each, links_of, names = zip(*found, strict=True) if found else ((),) * 5
    each = [np.array(v, np.int64) for v in (*each, list(map(len, links_of)))]
    wrong = np.concatenate([[0], np.cumsum((each[0] == 0)[code])])
    wrong = wrong[bounds[1:]] > wrong[bounds[:-1]]

    def total(v: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(v[code])])
        return np.where(wrong, 0, sums[bounds[1:]] - sums[bounds[:-1]])

    size = each[3] // 8
    out = {name: pa.array(total(v)) for name, v in zip(("n_a", "n_b", "n_groups"), each, strict=False)}
    n_links = total(size)
    groups, digests = [], []
    for k in range(len(texts)):
        text = b"" if wrong[k] else b"".join([names[c] for c in code[bounds[k] : bounds[k + 1]].tolist()])[:-1]
        groups.append(text.decode() if with_groups else None)
        digests.append(hashlib.sha256(text).hexdigest() if text else "")

    pairs, which = np.unique(np.frombuffer(b"".join(links_of), np.int64), return_inverse=True)
    first = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    if wrong.any():
        code, doc = code[~wrong[doc]], doc[~wrong[doc]]
    n = size[code]
    ends = np.cumsum(n)
    which = which[np.repeat(first[code] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
    keys, times = np.unique(np.repeat(doc, n) * len(pairs) + which, return_counts=True) if len(pairs) else (np.empty(0, np.int64), np.empty(0, np.int64))
    offsets = np.searchsorted(keys, np.arange(len(texts) + 1) * len(pairs)) if len(pairs) else np.zeros(len(texts) + 1, np.int64)
    struct = pa.StructArray.from_arrays([pa.array(pairs[keys % len(pairs)] if len(pairs) else keys), pa.array(times)], ["pair", "times"])
    out |= {"n_links": pa.array(n_links), "groups_sha256": pa.array(digests, pa.string())}
    out["links"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)
    if with_groups:
        out["groups"] = pa.array(groups, pa.string())
    return out


_MEASURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<pair: long, times: long>>"


def distinct_texts(docs: DataFrame) -> DataFrame:
    """``text``, its sha256 as ``key`` and how many documents have it (``copies``); neither null nor empty.  Copies are counted before the shuffle."""
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text <> ''")
    return texts.groupBy("text").agg(F.count("*").alias("copies")).withColumn("key", F.unhex(F.sha2("text", 256)))


def align_texts(texts: DataFrame, paths: tuple[str, str] | None = None, with_groups: bool = False) -> DataFrame:
    """Measures and distinct links of each row of :func:`distinct_texts`; with ``groups`` as text if asked for."""
    a_path, b_path = paths or default_paths()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = aligned(aligner(a_path, b_path), batch.column("text").to_pylist(), with_groups)
        return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("copies"), *out.values()], ["key", "copies", *out])

    return texts.select("key", "copies", "text").mapInArrow(batches(run, AT_ONCE), f"key binary, copies long, {_MEASURES}" + (", groups string" if with_groups else ""))


def pair_counts(measured: DataFrame) -> DataFrame:
    """``pair`` (B id shifted by 32 bits, with the A id), its links in the corpus ``n``, and ``best``: no pair of the B id has more."""
    links = measured.select("copies", F.inline("links"))
    counts = links.groupBy("pair").agg(F.sum(F.col("times") * F.col("copies")).alias("n"))
    b = F.shiftright("pair", 32).alias("b")
    most = counts.groupBy(b).agg(F.max("n").alias("most"))
    return counts.select("pair", "n", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment(work: Work, docs: DataFrame, paths: tuple[str, str] | None = None, with_groups: bool = False, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Per document: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256`` (and ``groups``).

    Counts of pairs are looked up by a join; their table is broadcast if it has at most ``broadcast_pairs`` rows.
    """
    measured = work.write(align_texts(distinct_texts(docs), paths, with_groups), "texts")
    counts = work.write(pair_counts(measured), "pairs")
    lookup = F.broadcast(counts) if counts.count() <= broadcast_pairs else counts
    links = measured.select("key", F.inline("links")).join(lookup, "pair")
    sums = links.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    plain = ["n_a", "n_b", "n_groups", "n_links"]
    texts = ["groups_sha256", "groups"] if with_groups else ["groups_sha256"]
    # written, so that Spark can split the join at a text with many copies
    done = work.write(measured.select("key", *plain, *texts).join(sums, "key", "left"), "measures")
    ids = docs.select("doc_id", F.unhex(F.sha2(F.col("text").cast("string"), 256)).alias("key"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*plain, "n_best", "count_sum")]
    return ids.join(done, "key", "left").select("doc_id", *zero, *[F.coalesce(c, F.lit("")).alias(c) for c in texts])
