"""Line dedup: a suffix array over sequences of line ids, by distributed prefix doubling.

A document is the sequence of its non-blank lines (blank: spaces only, tabs are text); a line's id is
a 128-bit hash of its text.  A run of lines of at least ``min_chars`` characters that also starts
earlier (smaller doc_id, or same document, earlier line) is deleted, however many lines it has.

1. *Ranks.*  The suffixes that start with a repeated line are ranked by that line.  Each round sorts
   the pairs (rank here, rank 2**k lines on) and numbers those that more than one suffix has: ranks
   by the first 2**(k+1) lines.  A suffix whose pair nobody shares is settled and drops out, and the
   rounds go on until all are.  Only different pairs are sorted, so a line that a third of all
   documents hold is one row there.
2. *Common prefixes.*  Suffixes of one rank are an interval of the suffix array with a common prefix
   of 2**k lines.  All but the first of the interval start a run that occurs earlier.
3. *Between powers of two.*  The longest common prefix with an earlier suffix is less than twice the
   largest such power.  It is found by splitting the interval by the ranks of the lines that follow,
   at 2**(k-1), 2**(k-2), ... lines: a suffix that isn't the first of its part goes on within it, and
   the first of every part goes on in the interval as before, since a longer prefix is not shared.
   This is done for runs whose lines after the first have fewer than ``min_chars`` characters; the
   end of any other maximal run is that of a run which starts a line later.

The deleted lines are the union of these maximal repeated runs; ``n_runs`` counts what is connected.

DataFrame operations only.  Classes are counted by aggregations that combine before their shuffle and
are written before they are joined back, so that Spark can split a join in which one class holds many
rows.  Rows with a null doc_id come before all others.  Rows that share a doc_id are told apart by a
hash of their text; if that is the same too, by a number.  Blank lines are kept and don't interrupt
runs; null texts are kept as they are; documents without lines have counts of zero.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Work

MIN_CHARS = 40
#: A document: whether its doc_id is known, the doc_id, a number or hash of the row.
DOC = ["known", "doc", "row"]
PLACE = [*DOC, "i"]


def _place() -> Column:
    return F.struct(*PLACE)


def _ranks(work: Work, rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ``rank``, ``first``: the earliest place) of the keys that several rows have, numbered in the order of the keys."""
    shared = rows.groupBy(*keys).agg(F.min(_place()).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    shared = work.write(shared, "shared")
    ranked = work.write(shared.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()), "ranks")
    work.drop(shared)
    return ranked


def suffix_ranks(work: Work, lines: DataFrame) -> list[DataFrame]:
    """For each k, the suffixes that share their first 2**k lines with others: place, ``r`` (rank), ``n`` (characters), ``a`` (of the first line), ``first``.

    ``lines``: place, ``h`` and ``g`` (line id), ``n``.
    """
    ranks = _ranks(work, lines, ["h", "g"])
    levels = [work.write(lines.join(ranks, ["h", "g"]).select(*PLACE, F.col("rank").alias("r"), "n", F.col("n").alias("a"), "first"), "level")]
    work.drop(ranks)
    while True:
        step = 1 << (len(levels) - 1)
        there = Window.partitionBy(*DOC).orderBy("i").rangeBetween(step, step)
        ahead = lambda c: F.first(c).over(there)
        pairs = levels[-1].select(*PLACE, "r", "a", (F.col("n") + 1 + ahead("n")).alias("n"), ahead("r").alias("x")).where("x is not null")
        pairs = work.write(pairs, "pairs")
        ranks = _ranks(work, pairs, ["r", "x"])
        if ranks.isEmpty():
            work.drop(pairs, ranks)
            return levels
        levels.append(work.write(pairs.join(ranks, ["r", "x"]).select(*PLACE, F.col("rank").alias("r"), "n", "a", "first"), "level"))
        work.drop(pairs, ranks)


def _undecided(levels: list[DataFrame], k: int, min_chars: int) -> DataFrame:
    """Suffixes of level k that must be split between 2**k and 2**(k+1) lines: (``l``: lines shared, ``f``: first of the interval, place, n)."""
    rows = levels[k].where(F.col("n") - F.col("a") - 1 < min_chars)
    if k + 1 < len(levels):
        rows = rows.join(levels[k + 1].where(_place() > F.col("first")).select(*PLACE), PLACE, "left_anti")
    return rows.select(F.lit(1 << k).alias("l"), F.col("first").alias("f"), *PLACE, "n")


def _split(work: Work, rows: DataFrame, level: DataFrame, lines: int) -> DataFrame:
    """Intervals split by the ranks of the ``lines`` lines after their common prefix."""
    following = level.select(*DOC, F.col("i").alias("at"), F.col("r").alias("x"), F.col("n").alias("more"))
    looked = work.write(rows.withColumn("at", F.col("i") + F.col("l")).join(following, [*DOC, "at"], "left").drop("at"), "looked")
    parts = looked.where("x is not null").groupBy("l", "f", "x").agg(F.min(_place()).alias("g"), F.count("*").alias("c")).where("c > 1").drop("c")
    parts = work.write(parts, "parts")
    both = looked.join(parts, ["l", "f", "x"], "left")
    inner = both.where("g is not null").select((F.col("l") + lines).alias("l"), F.col("g").alias("f"), *PLACE, (F.col("n") + 1 + F.col("more")).alias("n"))
    outer = both.where(F.col("g").isNull() | (F.col("g") == _place())).select("l", "f", *PLACE, "n")
    out = work.write(inner.unionByName(outer), "split")
    work.drop(looked, parts)
    return out


def repeated_runs(work: Work, lines: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(place, ``l``: lines) of runs of at least ``min_chars`` characters that also start earlier; together they cover all of them."""
    levels = suffix_ranks(work, lines)
    found = [t.where((_place() > F.col("first")) & (F.col("n") >= min_chars)).select(*PLACE, F.lit(1 << k).alias("l")) for k, t in enumerate(levels)]
    rows = None
    for k in range(len(levels) - 1, 0, -1):
        new = _undecided(levels, k, min_chars)
        if rows is None and new.isEmpty():
            continue
        before, rows = rows, _split(work, new if rows is None else rows.unionByName(new), levels[k - 1], 1 << (k - 1))
        if before is not None:
            work.drop(before)
    if rows is not None:
        found.append(rows.where((_place() > F.col("f")) & (F.col("n") >= min_chars)).select(*PLACE, "l"))
    runs = found[0]
    for more in found[1:]:
        runs = runs.unionByName(more)
    runs = work.write(runs, "runs")
    work.drop(*levels, *([] if rows is None else [rows]))
    return runs


def _removals(runs: DataFrame) -> DataFrame:
    """(document, ``at``: the sorted numbers of the lines that its runs cover)."""
    before = Window.partitionBy(*DOC).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.col("i") + F.col("l")).over(before)
    own = runs.select(*DOC, F.greatest("i", F.coalesce(reach, F.lit(0))).alias("start"), (F.col("i") + F.col("l") - 1).alias("last")).where("start <= last")
    spans = own.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("start", "last"))).alias("spans"))  # one for a line at most
    return spans.select(*DOC, F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["last"]))).alias("at"))


def _judged(work: Work, docs: DataFrame, min_chars: int) -> DataFrame:
    """(``own``: a row of ``docs``, ``done``: struct lines, removed, runs, text)."""
    text = F.coalesce(F.col("own.text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    rows = rows.select("own", F.col("own.doc_id").isNotNull().cast("int").alias("known"), F.coalesce(F.col("own.doc_id").cast("long"), F.lit(0)).alias("doc"), F.xxhash64(text).alias("row"))
    if not rows.groupBy(*DOC).count().where("count > 1").isEmpty():  # equal rows are told apart by a number, in a table that stays as it is
        rows = work.write(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    own_lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    ids = F.transform(own_lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(17), x, F.length(x)).alias("g"), F.length(x).alias("n")))
    lines = work.write(rows.select(*DOC, F.posexplode(ids).alias("i", "s")).select(*PLACE, "s.h", "s.g", "s.n"), "lines")
    runs = repeated_runs(work, lines, min_chars)
    gone = work.write(_removals(runs), "gone")
    work.drop(lines, runs)
    out = rows.join(gone.hint("merge"), DOC, "left")  # documents are shuffled at any size: the disk that takes grows with them, not by a jump
    return out.select("own", _delete(text, F.coalesce("at", F.array().cast("array<int>"))).alias("done"))


def _columns(docs: DataFrame) -> list[Column]:
    changed = F.col("done.removed") > 0
    return [(F.when(changed, F.col("done.text")).otherwise(F.col("own.text")) if c == "text" else F.col(f"own.`{c}`")).alias(c) for c in docs.columns]


def dedup(work: Work, docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """All rows and columns of ``docs``, with ``text`` less its deleted lines, and ``n_lines`` (non-blank ones), ``n_removed``, ``n_runs``.

    A column of ``docs`` that has one of these three names stays, and that count is left out.
    """
    counts = {"n_lines": "done.lines", "n_removed": "done.removed", "n_runs": "done.runs"}
    return _judged(work, docs, min_chars).select(*_columns(docs), *[F.col(v).alias(c) for c, v in counts.items() if c not in docs.columns])


def clean(work: Work, docs: DataFrame, min_chars: int = MIN_CHARS, chars: str = "n_chars") -> DataFrame:
    """As :func:`dedup`, with the columns of ``docs`` alone; documents of which only spaces are left go, and ``chars`` follows the text."""
    done = _judged(work, docs, min_chars).where((F.col("done.removed") == 0) | (F.trim("done.text") != ""))
    length = F.when(F.col("done.removed") > 0, F.length("done.text").cast("long")).otherwise(F.col(f"own.`{chars}`")) if chars in docs.columns else None
    return done.select(*[length.alias(c) if c == chars else x for c, x in zip(docs.columns, _columns(docs), strict=True)])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once for a row, also where the optimizer puts this into a filter."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _delete(text: Column, at: Column) -> Column:
    """Struct (lines, removed, runs, text) after deleting the non-blank lines numbered ``at`` (sorted)."""
    none = F.array().cast("array<int>")

    def places(lines: Column) -> Column:
        numbers = F.transform(lines, lambda x, i: F.when(F.trim(x) == "", F.lit(-1)).otherwise(i))
        return F.filter(numbers, lambda i: i >= 0)

    def result(s: Column) -> Column:
        doomed = F.transform(s["at"], lambda k: F.get(s["places"], k))
        kept = F.when(F.size(s["at"]) > 0, F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), doomed)).otherwise(none)
        runs = F.filter(s["at"], lambda k, i: (i == 0) | (F.coalesce(F.get(s["at"], i - 1), F.lit(-9)) != k - 1))
        joined = F.array_join(F.transform(kept, lambda i: F.get(s["lines"], i)), "\n")
        return F.struct(F.size(s["places"]).alias("lines"), F.size(s["at"]).alias("removed"), F.size(runs).alias("runs"), joined.alias("text"))

    with_places = lambda s: F.struct(s["lines"].alias("lines"), s["at"].alias("at"), places(s["lines"]).alias("places"))
    split = F.struct(F.split(text, "\n").alias("lines"), at.alias("at"))
    return _let(split, lambda s: _let(with_places(s), result))


#: A run of length k is the run of length k - 1 and a line; only runs that repeat go on to the next length.
ORACLE_SQL = """
WITH RECURSIVE l AS (
  SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
  WHERE trim(line) <> ''),
w AS (
  SELECT doc_id, i, 1 AS k, hash(line) AS run, length(line) AS n, count(*) OVER c AS c, row_number() OVER (c ORDER BY doc_id, i) AS nth FROM l WINDOW c AS (PARTITION BY line)
  UNION ALL
  SELECT doc_id, i, k, run, n, count(*) OVER c, row_number() OVER (c ORDER BY doc_id, i)
  FROM (SELECT w.doc_id, w.i, w.k + 1 AS k, hash(w.run, l.line) AS run, w.n + 1 + length(l.line) AS n
        FROM w JOIN l ON l.doc_id = w.doc_id AND l.i = w.i + w.k WHERE w.c > 1)
  WINDOW c AS (PARTITION BY run)),
g AS (SELECT DISTINCT doc_id, i + unnest(generate_series(0, k - 1)) AS i FROM w WHERE nth > 1 AND n >= 40),
s AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
        count(*) FILTER (WHERE g.i IS NOT NULL AND b.i IS NULL) AS n_runs
      FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i LEFT JOIN g AS b ON b.doc_id = l.doc_id AND b.i = l.i - 1 GROUP BY l.doc_id),
a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
t AS (SELECT a.doc_id, string_agg(a.line, chr(10) ORDER BY a.pos) AS kept FROM a LEFT JOIN l ON l.doc_id = a.doc_id AND l.pos = a.pos
      LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i WHERE g.i IS NULL GROUP BY a.doc_id)
SELECT d.doc_id, CASE WHEN coalesce(s.n_removed, 0) = 0 THEN d.text ELSE coalesce(t.kept, '') END AS text,
       coalesce(s.n_lines, 0)::INTEGER AS n_lines, coalesce(s.n_removed, 0)::INTEGER AS n_removed, coalesce(s.n_runs, 0)::INTEGER AS n_runs
FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN t USING (doc_id)
"""
