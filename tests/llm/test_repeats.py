"""Repeated passages, against all windows of all texts."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from dagtrail.llm import repeats
from tests.llm.samples import documents, prose, rows


def simple(found, length):
    texts = [(i, (t or "").encode()) for i, t, *_ in found]
    times = Counter(t[s : s + length] for _, t in texts for s in range(len(t) - length + 1))
    answer = []
    for doc_id, text in texts:
        out = np.zeros(len(text), dtype=bool)
        for s in range(len(text) - length + 1):
            if times[text[s : s + length]] > 1:
                out[s : s + length] = True
        kept = bytes(np.frombuffer(text, dtype=np.uint8)[~out])
        spans = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum())
        answer.append((doc_id, len(text), int(out.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(answer, key=repr)


def found_by(spark, found, length):
    answer = repeats.remove_repeats(documents(spark, found, clash=True), length)
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted(map(tuple, answer.select(*columns).collect()), key=repr)


def edited(seed, text, n):
    rnd, words = random.Random(seed), text.split()
    for at in rnd.sample(range(len(words)), n):
        words[at] = f"new{seed}x{at}"
    return " ".join(words)


def passages():
    """Near copies in crowds, shared passages around the length wanted, texts that repeat themselves, few letters."""
    crowd, shared = prose(900, 150), prose(901, 90)
    made = [(i, edited(i, crowd, 1 + i % 4)) for i in range(40)]
    made += [(100 + i, prose(700 + i, 40) + shared[i * 9 :] + prose(800 + i, 40)) for i in range(25)]
    made += [(200 + i, ("abcdefg" * 200)[i : 900 + 7 * i]) for i in range(3)] + [(210, "a" * 1500), (211, "b" + "a" * 399 + "b")]
    made += [(220, prose(5, 100) + prose(6, 50) + prose(5, 100)), (221, "x" * 399), (222, "y" * 400), (223, "é" * 500)]
    made += [(230 + i, "".join(random.Random(i).choice("ab") for _ in range(600))) for i in range(4)]
    return [(i, t, "xx", "a", 1) for i, t in made]


@pytest.mark.parametrize("length, bucket, chunk", [(400, 256, 1 << 19), (400, 3, 701), (24, 256, 333), (6, 5, 97)])
def test_against_all_windows(spark, monkeypatch, length, bucket, chunk):
    monkeypatch.setattr(repeats, "BUCKET", bucket)
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    repeats._powers.cache_clear()
    found = passages() + [r for r in rows() if len(r[1] or "") < 50_000]
    assert found_by(spark, found, length) == simple(found, length)


def test_long_texts_and_none(spark):
    found = rows()
    assert found_by(spark, found, 400) == simple(found, 400)
    assert found_by(spark, [], 400) == []


def test_kept_bytes(spark):
    found = [(1, "a" * 30 + "b" * 30, "x", "a", 1), (2, "b" * 30 + "c", "x", "a", 1), (3, None, "x", "a", 1)]
    kept = repeats.remove_repeats(documents(spark, found), 30, texts=True).collect()
    assert {r.doc_id: bytes(r.kept) for r in kept} == {1: b"a" * 30, 2: b"c", 3: b""}


def simple_groups(parts, leads, length):
    """Maximal repeats by extending every pair and gathering all with the same string."""
    texts, found = list(zip(parts, leads, strict=True)), set()
    for i, (p, a) in enumerate(texts):
        for q, b in texts[:i]:
            left = len(os.path.commonprefix([p[:a][::-1], q[:b][::-1]]))
            right = len(os.path.commonprefix([p[a:], q[b:]]))
            if left + right >= length and right:
                found.add((left, right, p[a - left : a + right]))
    groups = set()
    for left, right, text in found:
        members = {i for i, (p, a) in enumerate(texts) if a >= left and p[a - left : a + right] == text}
        groups.add((frozenset(members), left, right))
    return groups


@pytest.mark.parametrize("seed", range(12))
def test_groups_of_a_bucket(seed):
    rnd = random.Random(seed)
    parts, leads = [], []
    for _ in range(rnd.randint(2, 14)):
        lead = rnd.randint(0, 8)
        parts.append(bytes(rnd.choice(b"ab") for _ in range(lead)) + b"anchor" + bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 8))))
        leads.append(lead)
    parts, leads = zip(*sorted({(p, n) for p, n in zip(parts, leads, strict=True)}), strict=True)
    got = [(frozenset(m.tolist()), a, b) for m, a, b in repeats.bucket_repeats(list(parts), list(leads), 9)] if len(parts) > 1 else []
    assert len(got) == len(set(got)) and set(got) == simple_groups(parts, leads, 9)


def test_intervals_are_the_nodes_of_the_tree():
    words = sorted([b"abab", b"aba", b"abb", b"b", b"ba", b"c"])
    common = [0] + [len(os.path.commonprefix([a, b])) for a, b in zip(words, words[1:], strict=False)]
    nodes = [(n, words[a : b + 1]) for n, a, b in repeats.intervals(common)]
    assert nodes == [(3, words[:2]), (2, words[:3]), (1, words[3:5]), (0, words)]


def test_all_occurrences_of_a_repeat(spark):
    shared = prose(901, 100)[:450]
    found = [(i, prose(700 + i, 40) + shared + prose(800 + i, 40), "xx", "a", 1) for i in range(5)]
    groups = defaultdict(set)
    texts = {i: t.encode() for i, t, *_ in found}
    for r in repeats.repeat_groups(documents(spark, found)).collect():
        groups[r.anchor, r.nth].add((r.doc_id, texts[r.doc_id][r.start : r.stop]))
    assert groups and all(len({t for _, t in g}) == 1 and len(next(iter(g))[1]) >= 400 for g in groups.values())
    assert any({i for i, _ in g} == set(texts) for g in groups.values())


@pytest.mark.parametrize("chunk", [64, 301, 1 << 19])
def test_each_window_has_one_anchor_that_depends_on_the_window_alone(monkeypatch, chunk):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    text = (prose(4, 60) + "aaaa" * 30 + prose(4, 60)).encode()
    anchors = defaultdict(set)
    n = 0
    for start, size, lead, anchor in zip(*(c.tolist() for c in repeats.segments(text, 40)), strict=True):
        for s in range(start, start + size - 40 + 1):
            assert 0 <= start + lead - s <= 30
            anchors[text[s : s + 40]].add((start + lead - s, anchor))
            n += 1
    assert n == len(text) - 39 and all(len(a) == 1 for a in anchors.values())
