"""Secret scans: an inverted index of trigrams finds the texts that a rule may match.

Each rule's pattern gives a Boolean query of trigrams that all its matches hold. Blocks of
texts are indexed for these trigrams, postings are intersected and united, and only the
texts found are searched by the pattern itself. A rule without any certain trigram is
searched for in all texts.
"""

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dagtrail.llm.common import blocks, only
from dagtrail.llm.trigrams import Index, candidates, trigram_query, trigrams_of

# Bytes of text that are indexed together; a single text may be longer.


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and how long a group of the match must be."""

    kind: str
    pattern: "re.Pattern[bytes]"
    group: int = 0
    min_length: int = 0

    def spans(self, text: bytes) -> list[tuple[int, int]]:
        """Leftmost matches that do not overlap; those too short are dropped after matching."""
        found = self.pattern.finditer(text)
        return [m.span() for m in found if m.end(self.group) - m.start(self.group) >= self.min_length]


ASSIGNED = rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_RULES = (
    Rule("assign", re.compile(ASSIGNED, re.IGNORECASE), 2, 12),
    Rule("access", re.compile(rb"AKIA[A-Z0-9]+"), 0, 18),
    # a run of hexadecimal digits is matched whole, so its length can stand in the pattern
    Rule("hex", re.compile(rb"[0-9a-f]{16,}")),
)
# Published formats of keys and tokens.
MORE_RULES = (
    Rule("github", re.compile(rb"gh[opsur]_[A-Za-z0-9]{36,}")),
    Rule("slack", re.compile(rb"xox[abprs]-[A-Za-z0-9-]{10,}")),
    Rule("google", re.compile(rb"AIza[A-Za-z0-9_-]{35}")),
    Rule("stripe", re.compile(rb"[rs]k_live_[A-Za-z0-9]{24,}")),
    Rule("jwt", re.compile(rb"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    Rule("pem", re.compile(rb"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----")),
)
RULES = BASE_RULES + MORE_RULES

Span = tuple[str, int, int]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self._queries = [trigram_query(r.pattern) for r in rules]
        self._index = Index(set().union(*map(trigrams_of, self._queries)))

    def scan(self, texts: list[bytes]) -> list[list[Span]]:
        """Spans in each text by start, then in the rules' order; places count code points."""
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        postings = self._index.postings(data, offsets)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for order, (rule, query) in enumerate(zip(self.rules, self._queries, strict=True)):
            for i in candidates(query, postings, len(texts)).tolist():
                found[i] += [(a, order, b) for a, b in rule.spans(texts[i])]
        return [self._in_characters(t, sorted(f)) if f else [] for t, f in zip(texts, found, strict=True)]

    def _in_characters(self, text: bytes, spans: list[tuple[int, int, int]]) -> list[Span]:
        ends = sorted({x for a, _, b in spans for x in (a, b)})
        place, chars, at = {}, 0, 0
        for end in ends:
            chars += len(text[at:end].decode())
            place[end], at = chars, end
        return [(self.rules[o].kind, place[a], place[b]) for a, o, b in spans]


def _map_scanned(
    documents: DataFrame, carry: list[str], fields: list[T.StructField], rules: tuple[Rule, ...], row: Callable
) -> DataFrame:
    """Columns to carry and what `row` makes of a text and its spans."""
    schema = T.StructType([documents.schema[c] for c in carry] + fields)
    types = [pa.int64() if f.dataType == T.LongType() else pa.string() for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("secrets")
        scanner = Scanner(rules)
        for block in blocks(batches, -1):
            texts = [(t.as_py() or "").encode() for t in block.column(-1)]
            made = [row(t, s) for t, s in zip(texts, scanner.scan(texts), strict=True)]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*made, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*block.columns[:-1], *columns], names=schema.names)

    return documents.select(*carry, documents["text"].alias("_text")).mapInArrow(run, schema)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def find_secrets(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, a count for each base rule, the base spans' sha256, and all spans as text.

    A null or empty text has no spans; rows are scanned one by one, so repeated rows stay; very long texts are
    scanned whole; an empty table gives none.
    """
    base = [r.kind for r in BASE_RULES]

    def row(_text: bytes, spans: list[Span]) -> tuple:
        own = [s for s in spans if s[0] in base]
        counts = [sum(s[0] == kind for s in own) for kind in base]
        return (*counts, hashlib.sha256(joined(own).encode()).hexdigest(), joined(spans))

    fields = [T.StructField(f"n_{kind}", T.LongType()) for kind in base]
    fields += [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    return _map_scanned(documents, ["doc_id"], fields, rules, row)


def mask(text: str, spans: list[Span]) -> str:
    """The text with each stretch that spans cover replaced by the kind of its first span."""
    parts, at, covered = [], 0, 0
    for kind, a, b in spans:
        if a >= covered:
            parts += [text[at:a], f"[{kind}]"]
        covered = max(covered, b)
        at = max(at, covered)
    return "".join(parts) + text[at:]


def mask_secrets(documents: DataFrame, carry: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns to carry of each document, and `masked`: its text without secrets, empty if null."""
    fields = [T.StructField("masked", T.StringType())]
    return _map_scanned(documents, carry, fields, rules, lambda text, spans: (mask(text.decode(), spans),))
