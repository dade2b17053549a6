"""Near duplicates by exact similarity, against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dagtrail.llm import jaccard, simhash
from tests.llm.samples import documents, prose, rows, words


def simple_shingles(text, size=5):
    found = words(text)
    return {tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))} if found else set()


def simple_groups(found):
    """Rows' groups by comparing all sets with all."""
    sets = list({frozenset(simple_shingles(t)) for _, t, *_ in found})
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]) > 0:
                parent[root(i)] = root(j)
    number = {s: root(i) for i, s in enumerate(sets)}
    groups = {}
    for r in found:
        groups.setdefault(number[frozenset(simple_shingles(r[1]))], []).append(r[0])
    return [sorted(g, key=repr) for g in groups.values()]


def changed(seed, text, n):
    rnd, made = random.Random(seed), text.split()
    for at in rnd.sample(range(len(made)), n):
        made[at] = f"new{seed}x{at}"
    return " ".join(made)


def copies():
    """Texts at similarities around 0.8, a crowd of near copies, and a passage that unlike texts share."""
    crowd, passage = prose(900, 150), prose(901, 30)
    made = [(1000 + i, changed(i, prose(800 + i % 12, 140), i % 7)) for i in range(96)]
    made += [(2000 + i, changed(500 + i, crowd, 1 + i % 5)) for i in range(60)]
    made += [(3000 + i, prose(700 + i, 40) + " " + passage) for i in range(40)]
    return [(i, t, "xx", "a", 1) for i, t in made]


@pytest.mark.parametrize("short, slice_", [(24, 2_000), (2, 7)])
def test_groups_against_all_pairs(spark, monkeypatch, short, slice_):
    monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard, "SLICE", slice_)
    found = copies() + [r for r in rows() if len(r[1] or "") < 50_000]
    answer, groups = jaccard.near_duplicates(jaccard.numbered(documents(spark, found, clash=True), "doc_id", "text")).collect(), {}
    for r in answer:
        groups.setdefault(r.root, []).append(r.doc_id)
    assert sorted((sorted(g, key=repr) for g in groups.values()), key=repr) == sorted(simple_groups(found), key=repr)


def test_parities_never_differ_more_than_the_sets():
    rnd = np.random.default_rng(8)
    for n in (3, 400, 9000):
        one = np.unique(rnd.integers(0, 1 << 40, n))
        other = np.unique(np.concatenate([one[rnd.random(len(one)) < 0.8], rnd.integers(0, 1 << 40, n // 5)]))
        bits = [np.unpackbits(jaccard.parities(x).view(np.uint8)) for x in (one, other)]
        assert (bits[0] != bits[1]).sum() <= len(np.setxor1d(one, other))
        assert not (jaccard.parities(one) != jaccard.parities(one[::-1])).any()


def test_joins_by_number_leave_the_texts_in_place(spark):
    rows_ = jaccard.numbered(documents(spark), "doc_id", "text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = rows_.join(spark.range(5).withColumnRenamed("id", "row"), "row", "left_anti")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and joined.count() > 0
    assert not any(t.name.startswith("dagtrail") for t in spark.catalog.listTables())


def test_the_stage_drops_copies_at_a_similarity_of_four_fifths(spark):
    text = prose(42, 200)
    near = changed(7, text, 4)
    one, other = simple_shingles(text), simple_shingles(near)
    assert 0.8 <= len(one & other) / len(one | other) < 0.9
    docs = documents(spark, [(1, text, "xx", "a", 1), (2, near, "xx", "a", 1), (3, prose(43, 200), "xx", "a", 1)])
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_the_stage_keeps_one_of_repeated_rows(spark):
    found = [(1, prose(1, 90), "xx", "a", 1)] * 5 + [(None, prose(2, 90), "xx", "a", 1)] * 2 + [(None, None, "xx", "a", 1)] * 2
    docs = documents(spark, found + [(7, "", "xx", "a", 1), (9, prose(1, 90), "xx", "b", 1)], clash=True)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        [(1, prose(1, 90)), (None, prose(2, 90)), (7, "")], key=repr
    )
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_the_stage_takes_near_fingerprints_to_the_decision(spark, monkeypatch):
    text = prose(42, 2000)
    near, rest = text + " end", changed(7, text, 900)
    assert (simhash.fingerprint(text, 5) ^ simhash.fingerprint(near, 5)).bit_count() <= simhash.MAX_DISTANCE
    # no posted shingle proposes anything, and everything that fingerprints propose is decided on whole sets
    nothing = spark.createDataFrame([], "token long, set long, size long, at long, other long")
    monkeypatch.setattr(jaccard, "_lists", lambda postings: nothing)
    docs = documents(spark, [(i, t, "xx", "a", 1) for i, t in enumerate([text, near, rest, prose(43, 200)])])
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 2, 3]
    same = jaccard.numbered(docs, "doc_id", "text")
    every = same.select("row", F.lit(1).cast("long").alias("group"))
    assert jaccard.near_duplicates(same, groups=every).select("root").distinct().count() >= 3


@pytest.mark.parametrize("known", [False, True])
def test_all_links_of_a_group_are_connected_or_decided(spark, monkeypatch, known):
    nothing = spark.createDataFrame([], "token long, set long, size long, at long, other long")
    monkeypatch.setattr(jaccard, "_lists", lambda postings: nothing)
    # pairs of near copies in one group, of which only one can have the member that the others are met with first
    found = [(2 * i + j, prose(600 + i, 900) + " end" * j, "xx", "a", 1) for i in range(4) for j in range(2)]
    for (_, one, *_), (_, other, *_) in zip(found[::2], found[1::2], strict=True):
        assert (simhash.fingerprint(one) ^ simhash.fingerprint(other)).bit_count() <= simhash.MAX_DISTANCE
    same = jaccard.numbered(documents(spark, found), "doc_id", "text")
    groups = same.select("row", F.lit(1).cast("long").alias("group"))
    if known:
        prints = simhash.fingerprints(same.select(F.col("row").alias("doc_id"), "text"))
        groups = groups.join(prints.select(F.col("doc_id").alias("row"), "fingerprint"), "row")
    answer, roots = jaccard.near_duplicates(same, groups=groups).collect(), {}
    for r in answer:
        roots.setdefault(r.root, []).append(r.doc_id)
    assert sorted(map(sorted, roots.values())) == [[0, 1], [2, 3], [4, 5], [6, 7]]
