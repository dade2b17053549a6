"""Divergence of sources, against all terms of all pairs."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from dagtrail.llm import divergence
from tests.llm.samples import documents, prose, rows

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def simple(found, least=3, top=200):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in found:
        lang, source = lang or "", source or ""
        terms = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    answer = []
    for lang in {k[0] for k in counts}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        shares = {}
        whole = Counter()
        for (other, source), c in counts.items():
            if other == lang:
                total = sum(c[t] for t in kept)
                shares[source] = {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}
                whole.update({t: c[t] for t in kept})
        of_lang = {t: 1 + 10**9 * (whole[t] + 1) // (sum(whole.values()) + len(kept)) for t in kept}
        for source, p in shares.items():
            pairs = [(s, sum((p[t] - q[t]) ** 2 // q[t] for t in kept)) for s, q in shares.items() if s != source]
            above = [(t, (p[t] - of_lang[t]) ** 2 // of_lang[t]) for t in kept if counts[lang, source][t] and p[t] > of_lang[t]]
            for part, items in (("pair", pairs), ("term", above)):
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                answer += [(lang, source, part, item, v, i + 1) for i, (item, v) in enumerate(ordered) if part == "pair" or i < top]
    return sorted(answer)


def found_by(spark, found, **given):
    answer = divergence.divergence(documents(spark, found, clash=True), **given)
    return sorted(map(tuple, answer.select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.mark.parametrize("least, top", [(3, 200), (1, 5)])
def test_against_all_terms(spark, least, top):
    found = rows() + [(i, prose(i % 9, 30 + i), ["en", "de"][i % 2], f"s{i % 7 % 5}", 1) for i in range(80)]
    assert found_by(spark, found, min_documents=least, top_terms=top) == simple(found, least, top)


def test_no_documents_and_no_terms(spark):
    assert divergence.divergence(documents(spark, [])).count() == 0
    found = [(1, "12 345", "en", "a", 1), (2, None, "en", "b", 1), (3, "once", None, None, 1)]
    assert found_by(spark, found) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shared_paths_count_once_for_all_their_terms(monkeypatch):
    # sorted paths of (source, share, share of nothing), with the number of terms of each
    paths = [[(0, 5, 1)], [(0, 5, 1), (1, 7, 2)], [(0, 5, 1), (1, 7, 2), (2, 9, 3)], [(1, 7, 2), (2, 8, 3)]]
    times = np.array([4, 3, 2, 6])
    fields = np.array([e for p in paths for e in p])
    ends = np.cumsum([len(p) for p in paths])
    row, depth, passing = divergence._nodes(ends, fields, times)
    assert list(zip(depth.tolist(), passing.tolist(), strict=True)) == [(0, 9), (1, 5), (2, 2), (0, 6), (1, 6)]
    for size in (1, 1 << 18):
        monkeypatch.setattr(divergence, "COMBINATIONS", size)
        got = Counter()
        for one, other, forth, back in divergence.pair_corrections(ends, fields, times):
            for a, b, x, y in zip(one.tolist(), other.tolist(), forth.tolist(), back.tolist(), strict=True):
                got[a, b] += x
                got[b, a] += y
        want = Counter()
        for path, n in zip(paths, times.tolist(), strict=True):
            for a in path:
                for b in path:
                    if a[0] != b[0]:
                        f = lambda p, q: (p - q) ** 2 // q
                        want[a[0], b[0]] += n * (f(a[1], b[1]) - f(a[1], b[2]) - f(a[2], b[1]) + f(a[2], b[2]))
        assert got == want


def test_sums_beyond_64_bits_stay_exact():
    fields = np.array([(0, 10**9, 1), (1, 1, 1)])
    ((_, _, forth, _),) = divergence.pair_corrections(np.array([2]), fields, np.array([10**4]))
    f = lambda p, q: (p - q) ** 2 // q
    assert forth[0] == 10**4 * (f(10**9, 1) - f(10**9, 1) - f(1, 1) + f(1, 1))
    fields = np.array([(0, 10**9, 1), (1, 3, 1)])
    ((_, _, forth, _),) = divergence.pair_corrections(np.array([2]), fields, np.array([10**4]))
    assert forth[0] == 10**4 * (f(10**9, 3) - f(10**9, 1) - f(1, 3) + f(1, 1))
