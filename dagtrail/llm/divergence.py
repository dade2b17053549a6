"""Source divergence audit: how far the term shares of sources of a language are apart.

Each kept term of a language is a row: its nonzero counts by source, in the order of sources.
Rows are inserted into a frequent-pattern tree, where rows with the same beginning share a
path and a node holds the number of terms that pass it. The divergence of two sources starts
from a vocabulary that neither of them uses. Terms of one source are corrected by its
distinct counts, and terms of both by the tree: each combination of a node and an ancestor
gives one correction for all terms that pass the node.

The tree is never held. Sorted rows are its walk in depth-first order, so a batch of sorted
rows yields its nodes, and a node cut by the end of a batch only appears twice with its terms
divided. Rows are dealt by ranges of paths, which equal rows do not make uneven: they are
combined before.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dagtrail.llm.common import first_columns
from dagtrail.sources.paths import store_rows

# Terms are kept that occur in so many documents of the language.
MIN_DOCUMENTS = 3
# Shares are whole numbers of this part.
SHARES = 1_000_000_000
# Terms of a group in the report.
TOP_TERMS = 200
# Counters a task holds before it hands them on.
HELD = 300_000
# Combinations of node and ancestor that are worked out at once.
COMBINATIONS = 1 << 18
# Sums up to this are exact in 64 bits.
FITS = float(1 << 62)

# bytes below 128 that are no letters; A-Z become a-z
_LOWER = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalpha() else 32 if b < 128 else b for b in range(256))
_ELEMENT = "struct<source:int,n:bigint,p:bigint,zero:bigint>"


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and of characters beyond ASCII; only A-Z are lower-cased."""
    return text.encode().translate(_LOWER).split(b" ") if text else []


def term_counts(documents: DataFrame) -> DataFrame:
    """lang, source, term, n and docs: occurrences, and documents that have the term.

    An empty term counts the documents of the group. Null lang, source and text are empty. Counts
    are added up in tasks before they are shuffled, so a hot source or term sends few rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                words = pa.array(list(docs), pa.binary()).cast(pa.string())
                columns = [
                    pa.array([lang] * len(docs), pa.string()),
                    pa.array([source] * len(docs), pa.string()),
                    words,
                    pa.array([n[w] for w in docs], pa.int64()),
                    pa.array(list(docs.values()), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                text, lang, source = (batch.column(c)[i].as_py() or "" for c in range(3))
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(docs)
                found = Counter(terms_of(text))
                found[b""] = 0
                n.update(found)
                docs.update(found.keys())
                size += len(docs)
                if size > HELD:
                    yield from given()
                    size = 0
        yield from given()

    columns = first_columns(documents, "text", "lang", "source")
    counted = columns.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SHARES * (n + 1) / (total + terms)), in whole numbers beyond 64 bits on the way."""
    above = f"cast({SHARES} as decimal(10,0)) * (cast({n} as decimal(20,0)) + 1)"
    return F.expr(f"1 + ({above} div (cast({total} as decimal(20,0)) + {terms}))")


def distance(p: str, q: str) -> Column:
    """floor((p - q)^2 / q); shares are at most SHARES + 1, so it fits 64 bits."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _nodes(ends: np.ndarray, fields: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted paths, laid end to end: for each node its row, its depth and the terms that pass it."""
    begins = np.concatenate([[0], ends[:-1]])
    lengths = ends - begins
    # how many elements a path shares with the one before, level by level over those still equal
    shared = np.zeros(len(ends), dtype=np.int64)
    alive = np.arange(1, len(ends))
    depth = 0
    while len(alive):
        alive = alive[(lengths[alive] > depth) & (lengths[alive - 1] > depth)]
        same = (fields[begins[alive] + depth] == fields[begins[alive - 1] + depth]).all(axis=1)
        alive = alive[same]
        shared[alive] += 1
        depth += 1
    fresh = lengths - shared
    row = np.repeat(np.arange(len(ends)), fresh)
    depth_of = np.arange(len(row)) - np.repeat(np.cumsum(fresh) - fresh, fresh) + np.repeat(shared, fresh)
    # a node lasts until a later path parts at its depth or above; next node of no greater depth, by a stack scan
    upto = np.cumsum(times)
    last = np.empty(len(row), dtype=np.int64)
    stack: list[int] = []
    first_of = (np.cumsum(fresh) - fresh).tolist()
    for r, (s, at, n) in enumerate(zip(shared.tolist(), first_of, fresh.tolist(), strict=True)):
        if len(stack) > s:
            last[stack[s:]] = r
            del stack[s:]
        stack.extend(range(at, at + n))
    last[stack] = len(ends)
    passing = upto[last - 1] - upto[row] + times[row]
    return row, depth_of, passing


def pair_corrections(ends: np.ndarray, fields: np.ndarray, times: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Source of the ancestor, of the node, and the corrections of both directions.

    `fields` has source, share and share without occurrences of each element of the sorted paths.
    """
    row, depth, passing = _nodes(ends, fields, times)
    begins = np.concatenate([[0], ends[:-1]])
    upto = np.cumsum(depth)
    at = 0
    while at < len(row):
        before = int(upto[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(upto, before + COMBINATIONS, "right")))
        d = depth[at:to]
        node = np.repeat(begins[row[at:to]] + d, d)
        offset = np.arange(int(d.sum())) - np.repeat(np.cumsum(d) - d, d)
        up = np.repeat(begins[row[at:to]], d) + offset
        n = np.repeat(passing[at:to], d)
        one, other = fields[up], fields[node]
        sources = one[:, 0] << 32 | other[:, 0]
        order = np.argsort(sources, kind="stable")
        sources, n, one, other = sources[order], n[order], one[order], other[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(len(n), 1), bool), sources[1:] != sources[:-1]]))
        sums = []
        for a, b in ((one, other), (other, one)):
            p, q, p_zero, q_zero = a[:, 1], b[:, 1], a[:, 2], b[:, 2]
            value = _distances(p, q) - _distances(p, q_zero) - _distances(p_zero, q) + _distances(p_zero, q_zero)
            if float(np.abs(value).max(initial=0)) * float(n.sum()) > FITS:
                value, n = value.astype(object), n.astype(object)
            sums.append(np.add.reduceat(value * n, first) if len(first) else value)
        yield sources[first] >> 32, sources[first] & 0xFFFFFFFF, *sums
        at = to


def _tree(rows: DataFrame) -> DataFrame:
    """lang, one, other (numbers of sources) and the correction, a decimal, of terms that both have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            path = batch.column(1)
            flat = path.flatten()
            fields = np.stack([flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3)], axis=1).astype(np.int64)
            ends = np.cumsum(path.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            times = batch.column(2).to_numpy()
            cuts = [i for i in range(1, len(langs)) if langs[i] != langs[i - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(langs)], strict=True):
                if a == b:
                    continue
                low = int(ends[a - 1]) if a else 0
                for one, other, forth, back in pair_corrections(ends[a:b] - low, fields[low : ends[b - 1]], times[a:b]):
                    columns = [
                        pa.array([langs[a]] * (2 * len(one)), pa.string()),
                        pa.array(np.concatenate([one, other]), pa.int32()),
                        pa.array(np.concatenate([other, one]), pa.int32()),
                        pa.array([str(v) for v in [*forth, *back]], pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "one", "other", "value"])

    wanted = rows.where(F.size("path") > 1).groupBy("lang", "path").agg(F.count(F.lit(1)).alias("times"))
    ordered = wanted.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    found = ordered.mapInArrow(run, "lang string, one int, other int, value string")
    return found.withColumn("value", F.col("value").cast("decimal(38,0)"))


def _groups(counts: DataFrame, rows: DataFrame) -> DataFrame:
    """A row per language and source: its number in the order of sources, total, terms of the language."""
    sizes = rows.select("lang", F.explode("found").alias("found"))
    sizes = sizes.groupBy("lang", "found.source").agg(F.sum("found.n").alias("total"))
    langs = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    all_groups = counts.where("term = ''").select("lang", "source")
    known = all_groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    known = known.na.fill(0, ["total", "terms", "lang_total"])
    # a language's sources, in order; they are as few as what is reported of each of them is long
    known = known.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")))
    # without terms there is no share
    zero = F.when(F.col("terms") > 0, share("0", "total", "terms"))
    return store_rows(known.withColumn("zero", zero), "groups")


def divergence(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank.

    Part `pair`: the divergence from each other source of the language; part `term`: the terms
    that the source has more of than its language, up to `top_terms`. Null and empty texts have
    no terms but their group is reported; very long texts count whole; repeated rows count as
    often as they occur, also as documents; ties go to the smaller item in UTF-8; an empty table
    gives no rows; other columns are ignored.
    """
    counts = store_rows(term_counts(documents), "terms")
    found = F.sort_array(F.collect_list(F.struct("source", "n"))).alias("found")
    rows = counts.where("term <> ''").groupBy("lang", "term").agg(found, F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
    rows = store_rows(rows.where(F.col("docs") >= min_documents).select("lang", "term", "found", "lang_n"), "rows")
    groups = _groups(counts, rows)

    single = rows.select("lang", "term", "lang_n", F.explode("found").alias("found"))
    single = single.select("lang", "term", "lang_n", "found.source", "found.n").join(groups, ["lang", "source"])
    single = single.withColumn("p", share("n", "total", "terms"))

    above = single.withColumn("q", share("lang_n", "lang_total", "terms")).where("p > q")
    above = above.select("lang", "source", F.col("term").alias("item"), distance("p", "q").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = above.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top_terms)

    element = F.struct(F.col("number").cast("int").alias("source"), "n", "p", "zero")
    paths = single.groupBy("lang", "term").agg(F.sort_array(F.collect_list(element)).alias("path"))
    both = _tree(paths.select("lang", F.col("path").cast(f"array<{_ELEMENT}>").alias("path")))

    # terms of one source, by its distinct counts, against all others of its language
    names = ["lang", "number", "zero", "terms"]
    counted = single.groupBy("lang", "number", "zero", "p").agg(F.count(F.lit(1)).cast("decimal(20,0)").alias("times"))
    others = groups.select("lang", F.col("number").alias("other"), F.col("zero").alias("other_zero"))
    met = counted.join(others, "lang").where("number <> other")
    own = (distance("p", "other_zero") - distance("zero", "other_zero")) * F.col("times")
    theirs = (distance("other_zero", "p") - distance("other_zero", "zero")) * F.col("times")
    direct = met.groupBy("lang", "number", "other").agg(F.sum(own).alias("own"), F.sum(theirs).alias("theirs"))
    direct = direct.select("lang", F.inline(F.array(
        F.struct(F.col("number").alias("one"), F.col("other").alias("other"), F.col("own").alias("value")),
        F.struct(F.col("other").alias("one"), F.col("number").alias("other"), F.col("theirs").alias("value")),
    )))
    nothing = groups.select(*names).join(others, "lang").where("number <> other")
    start = F.coalesce(distance("zero", "other_zero") * F.col("terms").cast("decimal(20,0)"), F.lit(0))
    nothing = nothing.select("lang", F.col("number").alias("one"), "other", start.cast("decimal(38,0)").alias("value"))
    parts = nothing.unionByName(direct.withColumn("value", F.col("value").cast("decimal(38,0)"))).unionByName(both)
    pairs = parts.groupBy("lang", "one", "other").agg(F.sum("value").cast("long").alias("value"))
    named = groups.select("lang", F.col("number").alias("one"), "source")
    items = groups.select("lang", F.col("number").alias("other"), F.col("source").alias("item"))
    pairs = pairs.join(named, ["lang", "one"]).join(items, ["lang", "other"])
    pairs = pairs.select("lang", "source", "item", "value", F.row_number().over(by_value).alias("rank"))
    order = ["lang", "source", "part", "item", "value", "rank"]
    pairs, top = pairs.withColumn("part", F.lit("pair")), top.withColumn("part", F.lit("term"))
    return pairs.select(*order).unionByName(top.select(*order))
