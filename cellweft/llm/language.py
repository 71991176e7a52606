"""A hashed maximum-entropy language model with a class-factored softmax."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.llm.common import few_rows, keep, mix64, signature_rows

#: Word classes; the most frequent words have one each, the others share ``TAIL`` by their last letters and length.
CLASSES, TAIL = 128, 32
#: Words that every task knows with their counts, at most; all others are looked up by a join. Longer words are never among them.
KNOWN_WORDS, KNOWN_LENGTH = 1 << 17, 64
#: Buckets of the hashed pair feature, rounds of gradient steps, and the weight of the quadratic prior.
PAIR_BUCKETS, ROUNDS, PRIOR = 4096, 12, 0.5
#: Distinct words that a task counts before it hands them on.
HELD = 400_000
END = b""


def words_of(text: str) -> list[bytes]:
    """Words, parted by ASCII white space and ASCII lower-cased, and one end token."""
    return [*text.encode().lower().split(), END]


def tail_class(word: bytes) -> int:
    last = int.from_bytes(word[-2:], "little") * 31 + min(len(word), 12) // 4
    return CLASSES - TAIL + (last * 0x9E3779B1 >> 16) % TAIL


class Codes(dict):
    """The number of each known word; for any other word, ``n_known`` plus its class."""

    def __init__(self, words: list[bytes]) -> None:
        super().__init__((w, i) for i, w in enumerate(words))
        self.n_known = len(words)

    def __missing__(self, word: bytes) -> int:
        return self.n_known + tail_class(word)


@dataclass
class Vocabulary:
    """Known words by falling count with the end token first, and sums over all training words."""

    words: list[bytes]
    counts: np.ndarray
    tokens: int = 0
    distinct: int = 0
    #: Tokens, distinct words and words seen once, by class.
    sums: np.ndarray = field(default_factory=lambda: np.zeros((3, CLASSES)))

    def classes(self) -> np.ndarray:
        """Class of each code: the first words have classes of their own."""
        own = CLASSES - TAIL
        known = np.array([i if i < own else tail_class(w) for i, w in enumerate(self.words)], dtype=np.int64)
        return np.concatenate([known, np.arange(CLASSES)])

    def unseen(self) -> np.ndarray:
        """Share of unseen words in each class: that of words seen once, smoothed."""
        tokens, _, once = self.sums
        return np.where(tokens > 0, (once + 0.5) / (tokens + once + 1), 1.0)

    def log_in_class(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 of a word's share in its class. With one weight a word, the best softmax over a class has this closed form."""
        rest, tokens = self.unseen()[classes], self.sums[0][classes]
        return np.log10(np.where(counts > 0, (1 - rest) * counts / np.maximum(tokens, 1), rest))

    def log_base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.distinct + 1))


@dataclass
class Weights:
    """Feature weights by class: bias, previous word's class, the class before it (skip), and both (hashed)."""

    bias: np.ndarray
    last: np.ndarray
    skip: np.ndarray
    pair: np.ndarray

    @staticmethod
    def zero() -> Weights:
        return Weights(np.zeros((1, CLASSES)), *(np.zeros((n, CLASSES)) for n in (CLASSES, CLASSES, PAIR_BUCKETS)))

    def parts(self) -> list[np.ndarray]:
        return [self.bias, self.last, self.skip, self.pair]

    def log_softmax(self, context: np.ndarray) -> np.ndarray:
        z = sum(w[f] for w, f in zip(self.parts(), features(context), strict=True))
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def features(context: np.ndarray) -> list[np.ndarray]:
    """The four active features of each context ``previous class * CLASSES + class before it``."""
    hashed = (mix64(context.astype(np.uint64) + np.uint64(77)) % np.uint64(PAIR_BUCKETS)).astype(np.int64)
    return [np.zeros(len(context), dtype=np.int64), context // CLASSES, context % CLASSES, hashed]


def contexts(classes: np.ndarray, ends: np.ndarray, end_class: int) -> np.ndarray:
    """Context of each token of texts laid end to end; before a text stand end tokens."""
    last, skip = np.full(len(classes), end_class), np.full(len(classes), end_class)
    last[1:], skip[2:] = classes[:-1], classes[:-2]
    starts = np.append(0, ends[:-1])
    last[starts] = end_class
    skip[starts] = end_class
    skip[np.minimum(starts + 1, len(classes) - 1)] = end_class
    return last * CLASSES + skip


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

    for b in batches:
        for text in b.column(0).to_pylist():
            held.update(words_of(text))
            if len(held) > HELD:
                yield batch()
                held.clear()
    if held:
        yield batch()


def _class_sums(own: list[bytes]):
    classes = {w: i for i, w in enumerate(own)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, CLASSES), dtype=np.int64)
        for b in batches:
            c = b.column(1).to_numpy(zero_copy_only=False)
            at = np.array([classes[w] if w in classes else tail_class(w) for w in b.column(0).to_pylist()], dtype=np.int64)
            for i, weight in enumerate((c, np.ones_like(c), (c == 1).astype(np.int64))):
                np.add.at(sums[i], at, weight)
        used = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (used, *sums[:, used])], names=["class", "tokens", "distinct", "once"])
    return run


def _coded(batch: list[str], codes: Codes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words of all texts, their codes, and where each text ends."""
    words, ends = [], []
    for text in batch:
        words += words_of(text)
        ends.append(len(words))
    return words, np.fromiter(map(codes.__getitem__, words), dtype=np.int64, count=len(words)), np.array(ends, dtype=np.int64)


def _context_counts(vocabulary: Vocabulary):
    """How often each class follows each context: all that the gradient needs to know of the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, classes, sums = Codes(vocabulary.words), vocabulary.classes(), np.zeros(CLASSES ** 3, dtype=np.int64)
        for b in few_rows(batches):
            if b.num_rows:
                _, code, ends = _coded(b.column(0).to_pylist(), codes)
                c = classes[code]
                cell, n = np.unique(contexts(c, ends, 0) * CLASSES + c, return_counts=True)
                sums[cell] += n
        used = np.flatnonzero(sums)
        for i in range(0, len(used), 100_000):
            some = used[i:i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (some // CLASSES, some % CLASSES, sums[some])], names=["context", "class", "n"])
    return run


def _feature_sums(weights: Weights, expected: bool):
    """Sums of each feature and class over a partition of contexts, as sparse rows: as observed, or as the weights expect."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = [len(w) for w in weights.parts()]
        sums = np.zeros((sum(width), CLASSES))
        for b in batches:
            if not b.num_rows:
                continue
            context, lists = b.column(0).to_numpy(), b.column(1)
            at = np.repeat(np.arange(len(context)), np.diff(lists.offsets.to_numpy()))
            each = lists.flatten()
            seen = np.zeros((len(context), CLASSES))
            seen[at, each.field(0).to_numpy()] = each.field(1).to_numpy()
            if expected:
                seen = np.exp(weights.log_softmax(context)) * seen.sum(axis=1, keepdims=True)
            for f, offset in zip(features(context), np.cumsum([0, *width[:-1]]), strict=True):
                np.add.at(sums, f + offset, seen)
        rows = np.flatnonzero(sums.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([sums[r].astype(np.float32).tobytes() for r in rows], pa.binary())], names=["row", "sums"])
    return run


def _summed(table: DataFrame, weights: Weights, expected: bool) -> np.ndarray:
    total = np.zeros((sum(len(w) for w in weights.parts()), CLASSES))
    for row in table.mapInArrow(_feature_sums(weights, expected), "row bigint, sums binary").collect():
        total[row.row] += np.frombuffer(row.sums, dtype=np.float32)
    return total


def fit_weights(table: DataFrame, rounds: int = ROUNDS, prior: float = PRIOR) -> Weights:
    """Full-batch gradient steps on ``table(context, following)``, a row for each of at most ``CLASSES ** 2`` contexts.

    Each round, tasks sum the gradient of their contexts; what reaches the driver is bounded by features x classes for each task. A step is
    scaled by the sums of its own weight, so rare and frequent features move alike.
    """
    weights = Weights.zero()
    seen = _summed(table, weights, expected=False)
    for _ in range(rounds):
        hoped, at = _summed(table, weights, expected=True), 0
        for w in weights.parts():
            part = slice(at, at + len(w))
            w += (2 / len(weights.parts())) * (seen[part] - hoped[part] - prior * w) / (seen[part] + hoped[part] + prior)
            at += len(w)
    return weights


def _score_columns(vocabulary: Vocabulary, weights: Weights):
    """Sums over known words, and the other words with their numbers and classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, classes, known = Codes(vocabulary.words), vocabulary.classes(), len(vocabulary.words)
        after = weights.log_softmax(np.arange(CLASSES ** 2)).astype(np.float32) / np.float32(np.log(10))
        nothing = np.zeros(CLASSES)
        seen = np.concatenate([vocabulary.counts > 0, nothing > 0]).astype(np.int64)
        base = np.concatenate([vocabulary.log_base(vocabulary.counts), nothing])
        inside = np.concatenate([vocabulary.log_in_class(vocabulary.counts, classes[:known]), nothing])
        for b in few_rows(batches):
            words, code, ends = _coded(b.column(2).to_pylist(), codes)
            c = classes[code]
            model = after[contexts(c, ends, 0), c].astype(np.float64) + inside[code]
            starts = np.append(0, ends[:-1])
            sums = [np.add.reduceat(x, starts) for x in (np.ones(len(code), np.int64), seen[code], base[code], model)]
            places = np.flatnonzero(code >= known)
            edges = pa.array(np.searchsorted(places, np.append(0, ends)).astype(np.int32))
            rare = [pa.ListArray.from_arrays(edges, x) for x in (pa.array([words[p] for p in places], pa.binary()), pa.array(code[places] - known, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *[pa.array(x) for x in sums], *rare],
                                             names=["lineage", "is_train", "n_tokens", "n_known", "base_score", "score", "rare", "classes"])
    return run


def learn_vocabulary(texts: DataFrame, known_words: int = KNOWN_WORDS) -> tuple[Vocabulary, DataFrame]:
    """Counts of all words of ``texts(genes)`` as a written table ``word, c``, and the bounded part that every task knows."""
    counts = keep(texts.select("genes").mapInArrow(_count_words, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")))
    # Counts are cut at one of a few hundred steps, so that no task sorts and no more words than asked for reach the driver.
    level = F.floor(F.log2("c") * 8).cast("int")
    short = counts.filter((F.octet_length("word") <= KNOWN_LENGTH) & (F.octet_length("word") > 0)).withColumn("level", level)
    room, cut = known_words - 1, 2 ** 31 - 1
    for r in sorted(short.groupBy("level").count().collect(), key=lambda r: -r.level):
        if (room := room - r["count"]) < 0:
            break
        cut = r.level
    frequent = sorted(short.filter(F.col("level") >= cut).select("word", "c").collect(), key=lambda r: (-r.c, bytes(r.word)))
    ends = counts.filter(F.octet_length("word") == 0).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    vocabulary = Vocabulary([END, *[bytes(r.word) for r in frequent]], np.array([ends, *[r.c for r in frequent]], dtype=np.float64))
    own = vocabulary.words[:CLASSES - TAIL]
    sums = (counts.mapInArrow(_class_sums(own), "class bigint, tokens bigint, distinct bigint, once bigint").groupBy("class")
            .agg(*[F.sum(c).alias(c) for c in ("tokens", "distinct", "once")]).collect())
    for r in sums:
        vocabulary.sums[:, r["class"]] = r["tokens"], r["distinct"], r["once"]
    vocabulary.tokens, vocabulary.distinct = int(vocabulary.sums[0].sum()), int(vocabulary.sums[1].sum())
    return vocabulary, counts


def score_signatures(signatures: DataFrame, known_words: int = KNOWN_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """log10 probability of each text of ``signatures(lineage, genes, is_train)`` under a model learnt from those with ``is_train``.

    Tokens are words (ASCII lower case, parted by white space) and one end token. The model gives each token the product of two softmaxes:
    its class, from hashed n-gram and skip features of the two classes before it, and the word in its class; each class keeps a share
    for unseen words, so the probabilities of all words seen and of one unseen word a class sum to one. All training texts count: words are
    counted by a shuffle, and contexts with what follows them, which is all that the gradient needs, likewise. Gradient rounds run
    over the contexts in tasks. Texts are then scored in numpy batches; words beyond the ``known_words`` most frequent (or some fewer) are joined with their counts.

    Returns ``lineage, is_train, n_tokens, n_known, train_tokens, base_score, score``: tokens, those seen in training, all training
    tokens, the sum of ``log10((c + 1) / (N + V + 1))``, and the model's log10 probability.

    Null text is empty and has its end token; null ``is_train`` is false. Without training rows the base is 0 and classes are equally
    likely. Repeated rows count and are scored each; null lineages are kept; extra columns are left out.
    """
    rows = signature_rows(signatures, F.coalesce(F.col("is_train"), F.lit(False)).alias("is_train"))
    kind = rows.schema["lineage"].dataType.simpleString()
    train = rows.filter("is_train").select("genes")
    vocabulary, counts = learn_vocabulary(train, known_words)
    cells = train.mapInArrow(_context_counts(vocabulary), "context bigint, class bigint, n bigint").groupBy("context", "class").agg(F.sum("n").alias("n"))
    table = keep(cells.groupBy("context").agg(F.collect_list(F.struct("class", "n")).alias("following")).coalesce(4))
    weights = fit_weights(table, rounds)
    scored = keep(rows.select("lineage", "is_train", "genes").mapInArrow(
        _score_columns(vocabulary, weights),
        f"lineage {kind}, is_train boolean, n_tokens bigint, n_known bigint, base_score double, score double, rare array<binary>, classes array<int>")
        .withColumn("row", F.monotonically_increasing_id()))
    each = (scored.select("row", F.explode(F.arrays_zip("rare", "classes")).alias("r"))
            .select("row", F.col("r.rare").alias("word"), F.col("r.classes").alias("class")).join(counts.hint("merge"), "word", "left"))
    c = F.coalesce("c", F.lit(0))
    unseen = F.array(*[F.lit(float(x)) for x in vocabulary.unseen()])[F.col("class")]
    tokens = F.array(*[F.lit(float(max(x, 1))) for x in vocabulary.sums[0]])[F.col("class")]
    inside = F.log10(F.when(c > 0, (1 - unseen) * c / tokens).otherwise(unseen))
    base = F.log10((c + 1) / F.lit(float(vocabulary.tokens + vocabulary.distinct + 1)))
    more = each.groupBy("row").agg(F.count_if(c > 0).alias("k"), F.sum(base).alias("b"), F.sum(inside).alias("s"))
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return scored.drop("rare", "classes").join(more, "row", "left").select(
        "lineage", "is_train", "n_tokens", plus("n_known", "k").cast("long").alias("n_known"), F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        plus("base_score", "b").alias("base_score"), plus("score", "s").alias("score"))
