"""Trigram queries of regular expressions, and postings that answer them.

A query is True (any text may match), a trigram, or ("and" | "or", queries).
"""

import re
from collections.abc import Iterable
from functools import reduce
from re import _constants as C
from re import _parser

import numpy as np

Query = bool | bytes | tuple

# More strings than this are not told apart.
MAX_STRINGS = 64
_UNSET = 255


def all_of(queries: Iterable[Query]) -> Query:
    parts = list(dict.fromkeys(q for q in queries if q is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def any_of(queries: Iterable[Query]) -> Query:
    parts = list(dict.fromkeys(queries))
    return True if True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: Iterable[bytes]) -> Query:
    """What a text has if it has one of the strings."""
    return any_of(all_of(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings))


def _strings(op, arg) -> set[bytes] | None:
    """All lower-cased strings a part of a pattern matches, if they are few."""
    if op is C.LITERAL:
        return {bytes([arg]).lower()}
    if op is C.IN:
        chars: set[bytes] = set()
        for kind, value in arg:
            if kind is C.LITERAL:
                chars.add(bytes([value]).lower())
            elif kind is C.RANGE:
                chars |= {bytes([v]).lower() for v in range(value[0], value[1] + 1)}
            else:
                return None
        return chars if len(chars) <= 8 else None
    if op is C.SUBPATTERN:
        return _sequence_strings(arg[3])
    if op is C.BRANCH:
        parts = [_sequence_strings(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] == arg[1] or op is C.MAX_REPEAT and arg[:2] == (0, 1):
        once = _sequence_strings(arg[2])
        if once is None or arg[1] > 8:
            return None
        return {b""} | once if arg[0] == 0 else reduce(_joined, [once] * arg[0], {b""})
    return None


def _joined(heads: set[bytes] | None, tails: set[bytes]) -> set[bytes] | None:
    if heads is None or len(heads) * len(tails) > MAX_STRINGS:
        return None
    return {h + t for h in heads for t in tails}


def _sequence_strings(parts) -> set[bytes] | None:
    found: set[bytes] | None = {b""}
    for op, arg in parts:
        own = _strings(op, arg)
        found = None if own is None or found is None else _joined(found, own)
        if found is None:
            return None
    return found


def _sequence(parts) -> Query:
    """Runs of parts with few strings give trigrams; parts in between are asked on their own."""
    queries, run = [], {b""}
    for op, arg in parts:
        own = _strings(op, arg)
        longer = _joined(run, own) if own is not None else None
        if longer is not None:
            run = longer
            continue
        queries.append(_of_strings(run))
        run = own if own is not None else {b""}
        if op is C.SUBPATTERN:
            queries.append(_sequence(arg[3]))
        elif op is C.BRANCH:
            queries.append(any_of(_sequence(x) for x in arg[1]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0]:
            queries.append(_sequence(arg[2]))
    return all_of([*queries, _of_strings(run)])


def trigram_query(pattern: "re.Pattern[bytes]") -> Query:
    """Trigrams, lower-cased, that every match of the pattern has; True if none is certain."""
    return _sequence(_parser.parse(pattern.pattern, pattern.flags))


def trigrams_of(query: Query) -> set[bytes]:
    if isinstance(query, bytes):
        return {query}
    return set() if query is True else set().union(*map(trigrams_of, query[1]))


class Index:
    """Postings of the wanted trigrams in a block of texts."""

    def __init__(self, wanted: set[bytes]):
        self.wanted = sorted(wanted)
        if len(self.wanted) >= _UNSET:
            raise ValueError(f"at most {_UNSET - 1} trigrams, not {len(self.wanted)}")
        self._number = np.full(1 << 24, _UNSET, dtype=np.uint8)
        for i, t in enumerate(self.wanted):
            self._number[int.from_bytes(t, "big")] = i
        self._lower = np.array([*bytes(range(256)).lower()], dtype=np.uint8)

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> dict[bytes, np.ndarray]:
        """For each wanted trigram the numbers of the texts that hold it, ascending."""
        if len(data) < 3:
            return {t: np.empty(0, dtype=np.int64) for t in self.wanted}
        low = self._lower[data].astype(np.uint32)
        codes = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        number = self._number[codes]
        at = np.flatnonzero(number != _UNSET)
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[text + 1]
        key = np.unique(number[at[inside]].astype(np.int64) * len(offsets) + text[inside])
        ends = np.searchsorted(key, np.arange(1, len(self.wanted) + 1) * len(offsets))
        parts = np.split(key % len(offsets), ends[:-1]) if self.wanted else []
        return dict(zip(self.wanted, parts, strict=True))


def candidates(query: Query, postings: dict[bytes, np.ndarray], texts: int) -> np.ndarray:
    """Numbers of the texts that may match."""
    if query is True:
        return np.arange(texts)
    if isinstance(query, bytes):
        return postings[query]
    parts = [candidates(q, postings, texts) for q in query[1]]
    return reduce(np.intersect1d if query[0] == "and" else np.union1d, sorted(parts, key=len))
