"""Language-model scoring: counts of all words, a log-bilinear model, and scores of texts.

Words are counted over all training texts. The frequent ones, a bounded number, are known to
every task; the counts of all others are met by a join, which has no hot key as they are rare.
The most frequent words are classes of the model by themselves. All others, also those never seen,
belong to a class of words of the same form, and a word's probability is that of its class times
its share of the class.

Texts are dealt by their hashes over shards of a fixed number of tokens, whatever the partitions
they come in. The model is trained on each shard from the same start, in the order of the hashes,
and the shards' parameters are averaged by the number of tokens.
"""

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from dagtrail.llm.common import blocks, first_columns
from dagtrail.llm.lbl import CLASSES, SIZE, Parameters, Scorer, Trainer
from dagtrail.sources.paths import store_rows

# The end of a text; no word is empty.
END = ""
# Words known to every task: at most this many, the most frequent.
HEAD_WORDS = 200_000
# Parts into which words are dealt by their hashes where too many are tied.
TIED = 1 << 30
# Words a task counts before it hands them on.
COUNTED_WORDS = 300_000
# Tokens worked on at once.
CHUNK_TOKENS = 1 << 16
ROUNDS = 1
# Tokens of a shard: enough for the model to learn from by itself.
SHARD_TOKENS = 4_000_000
# Classes of words by form, at most half of all classes.
FORMS = 512
# Bytes at the end of a word that its form is told by.
FORM_BYTES = 3
# Texts whose repetitions a task remembers.
SEEN_TEXTS = 500_000
WIDTH = 2 * SIZE + 1


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, separated by ASCII white space."""
    return text.lower().split() if text else []


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes | None]:
    """The column's texts as they are stored, one at a time."""
    return (text.as_py() for text in batch.column(column).cast(pa.binary()))


def form_of(word: bytes, forms: int) -> int:
    """The class of words with the same ending."""
    return zlib.crc32(word[-FORM_BYTES:]) % forms


def word_forms(word: Column, forms: int) -> Column:
    """The same as an expression."""
    data = word.cast("binary")
    ending = F.when(F.octet_length(data) < FORM_BYTES, data).otherwise(F.substring(data, -FORM_BYTES, FORM_BYTES))
    return (F.crc32(ending) % forms).cast("int")


def word_counts(documents: DataFrame) -> DataFrame:
    """word and n, with the ends of texts as an empty word; counted in tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        ends = 0

        def given() -> pa.RecordBatch:
            words = pa.array(list(counts), pa.binary()).cast(pa.string())
            batch = pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for text in _texts(batch, 0):
                counts.update(words_of(text))
                ends += 1
                if len(counts) > COUNTED_WORDS:
                    yield given()
        yield given()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([ends], pa.int64())], names=["word", "n"])

    counted = first_columns(documents, "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


class Head:
    """The frequent words, most frequent first, and what is known of all counts."""

    def __init__(self, counts: DataFrame, classes: int = CLASSES, head_words: int = HEAD_WORDS):
        totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.tokens, self.distinct = totals.n, totals.v
        words = counts.where(F.col("word") != END)
        # how many words have at least a count: a row for each count that occurs
        as_many = words.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
        upwards = as_many.withColumn("upto", F.sum("words").over(Window.orderBy(F.desc("n"))))
        least = upwards.where(F.col("upto") <= head_words).agg(F.min("n")).first()[0]
        top = upwards.orderBy(F.desc("n")).first()
        if least is not None:
            found = words.where(F.col("n") >= least)
        else:
            # too many words share the highest count: about half as many as may be known, by their hashes
            share = int((head_words / 2 / top.words if top else 0) * TIED)
            found = words.where((F.col("n") == F.lit(top.n if top else None)) & (F.pmod(F.xxhash64("word"), F.lit(TIED)) < share))
        known = sorted(((r.word, r.n) for r in found.toLocalIterator()), key=lambda x: (-x[1], x[0]))
        self.words = "\n".join(w for w, _ in known).encode()
        self.counts = np.array([n for _, n in known], dtype=np.int64)
        self.ends = (counts.where(F.col("word") == END).agg(F.coalesce(F.sum("n"), F.lit(0))).first())[0]
        self.forms = max(1, min(FORMS, classes // 2))
        self.modelled = max(0, min(len(known), classes - 1 - self.forms))
        self.end = self.modelled + self.forms
        own = np.array([form_of(w.encode(), self.forms) for w, _ in known], dtype=np.int64)
        self.classes = np.where(np.arange(len(known)) < self.modelled, np.arange(len(known)), self.modelled + own)
        # words and tokens of each form, but for the words that are classes
        self.form_tokens, self.form_distinct = np.zeros((2, self.forms), dtype=np.int64)
        by_form = words.groupBy(word_forms(F.col("word"), self.forms).alias("form"))
        for r in by_form.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
            self.form_tokens[r.form], self.form_distinct[r.form] = r.n, r.v
        np.subtract.at(self.form_tokens, own[: self.modelled], self.counts[: self.modelled])
        np.subtract.at(self.form_distinct, own[: self.modelled], 1)

    def shares(self) -> np.ndarray:
        """Shares of the classes; forms and the end have one more than their counts."""
        own = self.counts[: self.modelled]
        n = np.concatenate([own, self.form_tokens + 1, [self.ends + 1]]).astype(np.float64)
        return n / n.sum()


class _Numbers(dict):
    """Numbers of frequent words; what others have is -1 less their form and is not kept."""

    def __init__(self, words: list[bytes], forms: int):
        super().__init__(zip(words, range(len(words)), strict=True))
        self._forms = forms

    def __missing__(self, word: bytes) -> int:
        return -1 - form_of(word, self._forms)


@lru_cache(1)
def _numbers(words: bytes, empty: bool, forms: int) -> _Numbers:
    return _Numbers([] if empty else words.split(b"\n"), forms)


class _Reader:
    """Words as numbers of frequent words or forms, and as classes with the two before."""

    def __init__(self, head: Head):
        self.head = head
        self._number = _numbers(head.words, not len(head.counts), head.forms).__getitem__

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Numbers of frequent words; others have -1 less their form."""
        return np.fromiter(map(self._number, words), np.int64, len(words))

    def classes(self, numbers: np.ndarray) -> np.ndarray:
        """Classes of a text's words and of its end."""
        head = self.head
        found = np.full(len(numbers) + 1, head.end, dtype=np.int64)
        frequent = numbers >= 0
        found[:-1][frequent] = head.classes[numbers[frequent]]
        found[:-1][~frequent] = head.modelled - 1 - numbers[~frequent]
        return found

    def contexts(self, classes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes of the texts' tokens, and the classes one and two before."""
        word = np.concatenate(classes)
        starts = np.cumsum([0] + [len(c) for c in classes[:-1]])
        last = np.concatenate([[self.head.end], word[:-1]])
        before = np.concatenate([[self.head.end], last[:-1]])
        before[starts] = self.head.end
        return word, last, before


def _shards(training: DataFrame, head: Head) -> DataFrame:
    """shard, key and classes (16 bits each) of every text; each shard in one partition, by key.

    Rows of one id and text are told apart by how many a task has met, so that many of them are
    dealt over all shards; they are alike, so it does not matter which goes where.
    """
    n = max(1, round(head.tokens / SHARD_TOKENS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(head)
        seen: dict[int, int] = {}
        for batch in batches:
            for part in blocks(iter([batch]), 1):
                nth, classes = [], []
                for key, text in zip(part.column(0).to_pylist(), _texts(part, 1), strict=True):
                    nth.append(seen.get(key, 0))
                    seen[key] = nth[-1] + 1
                    classes.append(reader.classes(reader.numbers(words_of(text))).astype("<u2").tobytes())
                if len(seen) > SEEN_TEXTS:
                    seen.clear()
                columns = [part.column(0), pa.array(nth, pa.int64()), pa.array(classes, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "nth", "classes"])

    texts = training.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    read = texts.mapInArrow(run, "key long, nth long, classes binary")
    keyed = read.select(F.xxhash64("key", "nth").alias("key"), "classes")
    dealt = keyed.select(F.pmod("key", F.lit(n)).cast("int").alias("shard"), "key", "classes")
    return dealt.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "key", "classes")


def _train_round(training: DataFrame, head: Head, rows: np.ndarray) -> np.ndarray:
    """One pass over the texts of all shards; the average of the shards' parameters."""
    shares = head.shares()
    names = [f"p{i}" for i in range(WIDTH)]
    schema = "row int, tokens long, " + ", ".join(f"{n} float" for n in names)

    def learnt(trainer: Trainer) -> pa.RecordBatch:
        made = trainer.p.rows().astype(np.float32)
        index = pa.array(np.arange(len(made), dtype=np.int32))
        tokens = pa.array(np.full(len(made), trainer.tokens, dtype=np.int64))
        columns = [pa.array(c) for c in np.ascontiguousarray(made.T)]
        return pa.RecordBatch.from_arrays([index, tokens, *columns], names=["row", "tokens", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(head)
        trainer, at, held, size = None, None, [], 0
        for batch in batches:
            for shard, classes in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if shard != at or size >= CHUNK_TOKENS:
                    if held:
                        trainer.learn(*reader.contexts(held))
                    held, size = [], 0
                if shard != at:
                    if trainer:
                        yield learnt(trainer)
                    trainer, at = Trainer(Parameters.from_rows(rows), shares, shard), shard
                held.append(np.frombuffer(classes.as_py(), dtype="<u2").astype(np.int64))
                size += len(held[-1])
        if trainer:
            trainer.learn(*reader.contexts(held))
            yield learnt(trainer)

    trained = _shards(training, head).mapInArrow(run, schema)
    weight = F.col("tokens").cast("double")
    averages = [(F.sum(F.col(n) * weight) / F.sum(weight)).alias(n) for n in names]
    # a row for each class
    averaged = trained.groupBy("row").agg(*averages).orderBy("row").collect()
    return np.array([r[1:] for r in averaged], dtype=np.float64) if averaged else rows


def train(training: DataFrame, head: Head, rounds: int = ROUNDS) -> np.ndarray:
    """The model's parameters as rows, learnt from all training texts."""
    rows = Parameters.initial(head.shares()).rows()
    for _ in range(rounds):
        rows = _train_round(training, head, rows)
    return rows


@lru_cache(1)
def _scorer(data: bytes, width: int) -> Scorer:
    return Scorer(Parameters.from_rows(np.frombuffer(data, dtype=np.float32).reshape(-1, width)))


_SCORED = (
    "doc_id long, held_out boolean, row long, n_tokens long, n_known long, log_counts double, log_model double, "
    "rest array<struct<word:string,times:long>>"
)


def _score_known(documents: DataFrame, held_out: Column, head: Head, rows: np.ndarray) -> DataFrame:
    """What each text's frequent words give, and its other words with their numbers."""
    data = rows.astype(np.float32).tobytes()
    log_count = np.log10(head.counts + 1.0)
    log_end = float(np.log10(head.ends + 1.0))
    # what a class's share is divided by for a word of a form; nothing for words that are classes
    own_norm = np.zeros(head.end + 1)
    own_norm[head.modelled : head.end] = np.log10(head.form_tokens + head.form_distinct + 1.0)
    tail = pa.list_(pa.struct([("word", pa.string()), ("times", pa.int64())]))
    types = [pa.int64()] * 3 + [pa.float64()] * 2 + [tail]
    names = [c.split()[0] for c in _SCORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, scorer = _Reader(head), _scorer(data, WIDTH)
        row = TaskContext.get().partitionId() << 33

        def scored(texts: list[list[bytes]], numbers: list[np.ndarray]) -> list[tuple]:
            word, last, before = reader.contexts([reader.classes(n) for n in numbers])
            log_model = scorer.log_probabilities(word, last, before) / np.log(10) - own_norm[word]
            starts = np.concatenate([[0], np.cumsum([len(n) + 1 for n in numbers])[:-1]])
            models = np.add.reduceat(log_model, starts).tolist()
            made = []
            for words, number, model in zip(texts, numbers, models, strict=True):
                known = number[number >= 0]
                times: dict[bytes, int] = {}
                for i in np.flatnonzero(number < 0).tolist():
                    times[words[i]] = times.get(words[i], 0) + 1
                logs = float(log_count[known].sum()) + log_end
                # words of the head that are no class of their own
                model += float(log_count[known[known >= head.modelled]].sum())
                n_known = len(known) + (head.ends > 0)
                others = [{"word": w.decode(), "times": n} for w, n in times.items()]
                made.append((len(words) + 1, n_known, logs, model, others))
            return made

        for batch in batches:
            low, texts, numbers, size = 0, [], [], 0
            for i, text in enumerate(_texts(batch, 2)):
                texts.append(words_of(text))
                numbers.append(reader.numbers(texts[-1]))
                size += len(texts[-1]) + 1
                if size >= CHUNK_TOKENS or i + 1 == batch.num_rows:
                    made = list(zip(*scored(texts, numbers), strict=True))
                    index = pa.array(np.arange(row, row + len(texts)))
                    columns = [pa.array(list(c), t) for c, t in zip(made, [*types[:2], *types[3:]], strict=True)]
                    own = [batch.column(c).slice(low, i + 1 - low) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*own, index, *columns], names=names)
                    row += len(texts)
                    low, texts, numbers, size = i + 1, [], [], 0

    return documents.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, _SCORED)


def score_documents(documents: DataFrame, held_out: Column, rounds: int = ROUNDS) -> DataFrame:
    """Base and model score of every text, learnt from the rows where `held_out` is false.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, both log10. A null
    or empty text is its end alone. Rows are scored one by one, so repeated rows stay; very long texts count
    whole; an empty table gives none. Without training texts every base probability is 1 and the model
    knows the forms and the end alone.
    """
    training = documents.where(~held_out)
    counts = store_rows(word_counts(training), "counts")
    head = Head(counts)
    rows = train(training, head, rounds)
    scored = store_rows(_score_known(documents, held_out, head, rows), "scored")
    rest = scored.select("row", F.inline("rest"))
    found = rest.join(counts, "word").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rest_logs"), F.sum("times").alias("rest_known")
    )
    whole = scored.drop("rest").join(found, "row", "left")
    rest_logs = F.coalesce("rest_logs", F.lit(0.0))
    norm = float(np.log10(head.tokens + head.distinct + 1))
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(head.tokens).cast("long").alias("train_tokens"),
        (F.col("log_counts") + rest_logs - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("log_model") + rest_logs).alias("score"),
    )
