"""Quality rules on how a public tokenizer takes a text: its fertility.

Measured on the pieces of each word: characters per token, the share of byte-fallback tokens,
and the entropy of the text's tokens against what good text of that length has. Bands for
each language, or for the script where the language is not known, decide.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dagtrail.llm.common import blocks, only, remembers

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
SYMBOLS = b"#*$%&|<>"
BLANKS = " \t\n\v\f\r"
# Words remembered by one worker, about 200 bytes each.
REMEMBERED = 300_000
_SERIAL_BITS = 21


@dataclass(frozen=True)
class Band:
    """What good text of a language or script looks like.

    Expected entropy in bits is a parabola in the binary logarithm of the number of words, as
    far as its peak. A text is rejected if its entropy misses that by `gap`, or by `gap_if_short`
    while its characters per token are `short` below the language's mean, or if an outer bound is
    broken.
    """

    chars_per_token: float
    entropy: tuple[float, float, float]
    gap: float = 0.45
    gap_if_short: float = 0.30
    short: float = 0.12
    outer: tuple[float, float] = (1.2, 6.0)
    byte_share: float = 0.1

    def expected_entropy(self, n_words: int) -> float:
        a, b, c = self.entropy
        x = min(math.log2(n_words), -b / (2 * c))
        return a + b * x + c * x * x

    def accepts(self, n_words: int, chars_per_token: float, byte_share: float, entropy: float) -> bool:
        missing = self.expected_entropy(n_words) - entropy
        low = chars_per_token < self.chars_per_token - self.short
        return (
            self.outer[0] <= chars_per_token <= self.outer[1]
            and byte_share <= self.byte_share
            and missing <= self.gap
            and not (low and missing > self.gap_if_short)
        )


# Means and curves of documents labelled as good, for piece_bpe_32k.
LANGUAGE_BANDS = {
    "en": Band(2.218, (2.372, 0.824, -0.037)),
    "de": Band(2.241, (2.980, 0.683, -0.031)),
    "fr": Band(1.978, (3.164, 0.642, -0.029)),
    "es": Band(1.941, (2.399, 0.834, -0.040)),
}
# Languages without a band of their own: only what no text of the script does.
SCRIPT_BANDS = {
    "latin": Band(2.0, (2.0, 0.7, -0.033), gap=1.5, gap_if_short=1.5, byte_share=0.2),
    "other": Band(0.5, (2.0, 0.7, -0.033), gap=2.0, gap_if_short=2.0, outer=(0.1, 8.0), byte_share=0.95),
}

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, chars_per_token double, byte_share double, token_entropy double"
)


class _Pieces(dict):
    """Word to the ids of its pieces, as unsigned 16-bit integers."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor):
        super().__init__()
        self._encode = model.encode

    def __missing__(self, word: bytes) -> bytes:
        ids = np.array(self._encode(word.decode()), dtype=np.uint16).tobytes()
        if len(self) < REMEMBERED:
            self[word] = ids
        return ids


class _Serials(dict):
    """Word to a running number."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Fertility:
    """Measures of one text after the other."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self._pieces = _Pieces(model)
        self._serials = _Serials()
        self._is_byte = np.array([model.IsByte(i) for i in range(model.GetPieceSize())])

    def repeats(self, words: list[bytes]) -> int:
        """Words inside windows of `WINDOW` words that occur twice or more."""
        if len(words) <= WINDOW:
            return 0
        if len(self._serials) > REMEMBERED:
            self._serials.clear()
        serial = np.fromiter(map(self._serials.__getitem__, words), dtype=np.int64, count=len(words))
        if serial.max() >> _SERIAL_BITS:
            serial = np.unique(serial, return_inverse=True)[1]
        a, b, c = serial[:-2], serial[1:-1], serial[2:]
        if serial.max() >> _SERIAL_BITS:  # more words than fit into one number
            pair = np.unique(np.stack([a, b]), axis=1, return_inverse=True)[1].ravel()
            key = np.unique(np.stack([pair, c]), axis=1, return_inverse=True)[1].ravel()
        else:
            key = (a << 2 * _SERIAL_BITS) | (b << _SERIAL_BITS) | c
        ordered = np.sort(key)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            return 0
        at = np.searchsorted(twice, key)
        found = np.flatnonzero(twice[np.minimum(at, len(twice) - 1)] == key)
        marked = np.zeros(len(words), dtype=bool)
        for step in range(WINDOW):
            marked[found + step] = True
        return int(marked.sum())

    def tokens(self, words: list[bytes]) -> tuple[int, int, float]:
        """Number of tokens, of byte-fallback tokens, and entropy in bits."""
        ids = np.sort(np.frombuffer(b"".join(map(self._pieces.__getitem__, words)), dtype=np.uint16))
        if not len(ids):
            return 0, 0, 0.0
        counts = np.diff(np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]])))
        share = counts / len(ids)
        return len(ids), int(self._is_byte[ids].sum()), float(-(share * np.log2(share)).sum())

    def measure(self, text: str | None, lang: str | None, bands: dict[str, Band]) -> tuple:
        """The values of `MEASURES`. A null text has no words and fails the base rules."""
        text = text or ""
        data = text.encode()
        words = data.split()
        n = len(words)
        chars = len(text) - sum(text.count(s) for s in BLANKS)
        lines = [x for x in data.split(b"\n") if x.strip()]
        repeats = self.repeats(words)
        tokens, fallback, entropy = self.tokens(words)
        failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
        chars_per_token, byte_share = (chars / tokens, fallback / tokens) if tokens else (0.0, 0.0)
        kept = not failed and (bands.get(lang) or SCRIPT_BANDS[_script(text)]).accepts(
            n, chars_per_token, byte_share, entropy
        )
        symbols = len(data) - len(data.translate(None, SYMBOLS))
        return (n, chars, symbols, len(lines) - len(set(lines)), repeats, failed, kept) + (
            chars_per_token,
            byte_share,
            entropy,
        )


def _script(text: str) -> str:
    """Latin where most of its letters are below U+0250."""
    letters = [c for c in set(text) if c.isalpha()]
    return "latin" if 2 * sum(c < "ɐ" for c in letters) >= len(letters) else "other"


@lru_cache(1)
def _fertility(model_file: str) -> Fertility:
    remembers("quality", _fertility.cache_clear)
    return Fertility(model_file)


def judge(
    documents: DataFrame, model_file: str, carry: tuple[str, ...] = ("doc_id",), bands: dict[str, Band] | None = None
) -> DataFrame:
    """The columns to carry of each document, and its measures and verdict (`MEASURES`).

    Needs text and lang; a null language is judged by its script. Rows are judged one by one, so
    repeated rows stay and an empty table gives none.
    """
    bands = LANGUAGE_BANDS if bands is None else bands
    measures = T._parse_datatype_string(MEASURES)
    schema = T.StructType([documents.schema[c] for c in carry] + measures.fields)
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("quality")
        fertility = _fertility(model_file)
        for batch in blocks(batches, -2):
            texts, langs = batch.columns[-2:]
            made = [fertility.measure(t.as_py(), lang, bands) for t, lang in zip(texts, langs.to_pylist(), strict=True)]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*made, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *columns], names=schema.names)

    rows = documents.select(*carry, documents["text"].alias("_text"), documents["lang"].alias("_lang"))
    return rows.mapInArrow(run, schema)
