"""Discovery texts that repeat passages of projection texts, found by winnowing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.llm.common import gaps, keep, signature_rows, sliding_hash, word_hashes

#: A window has so many words. Fingerprints are minima of ``WINDOW - GRAM + 1`` consecutive hashes of ``GRAM`` words, so every shared
#: run of ``WINDOW`` words shares one.
WINDOW, GRAM = 10, 5
_GAP = gaps("alnum")
_SPACED = bytes(32 if _GAP[b] else b for b in range(256))
_NONE = np.zeros(0, dtype=np.uint64)


def winnow(grams: np.ndarray) -> np.ndarray:
    """The smallest of each run of ``WINDOW - GRAM + 1`` hashes of ``GRAM`` words, each value once."""
    runs = len(grams) - (WINDOW - GRAM)
    if runs <= 0:
        return _NONE
    low = grams[:runs].copy()
    for i in range(1, WINDOW - GRAM + 1):
        np.minimum(low, grams[i:i + runs], out=low)
    return np.unique(low[np.append(True, low[1:] != low[:-1])])


def short_grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, apart from those of other lengths: an item shorter than a window is its own fingerprint."""
    return sliding_hash(words, n) + np.uint64(n)


def item_prints(words: np.ndarray) -> np.ndarray:
    return winnow(sliding_hash(words, GRAM)) if len(words) >= WINDOW else short_grams(words, len(words)) if len(words) else _NONE


def _print_columns(short: list[int] | None):
    """Fingerprints of each text as a list column; ``short``: the lengths of short items, or None for the items themselves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = []
            for text in batch.column(1).to_pylist():
                words = word_hashes(text.encode().lower(), _GAP)
                if short is None:
                    prints.append(item_prints(words))
                else:
                    prints.append(winnow(sliding_hash(words, GRAM)))
                    if short:
                        prints[-1] = np.unique(np.concatenate([prints[-1], *[short_grams(words, n) for n in short if n <= len(words)]]))
            ends = np.cumsum([0, *map(len, prints)]).astype(np.int32)
            flat = np.concatenate([_NONE, *prints]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(flat))], names=["key", "prints"])
    return run


def _windows(text: str) -> tuple[int, frozenset[tuple[bytes, ...]], np.ndarray]:
    """Words in a window of this item, its windows, and its fingerprints."""
    words = text.encode().lower().translate(_SPACED).split()
    n = min(len(words), WINDOW)
    return n, frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1)), item_prints(word_hashes(text.encode().lower(), _GAP))


def extend(text: str, items: list[tuple[object, str]], memo: dict) -> tuple[int, list[object]]:
    """Words of ``text`` in windows of any of ``items``, and which items have such windows.

    Each place whose hash is a fingerprint of an item is extended to the windows around it, and those are compared word by word. ``memo``
    keeps the windows of items from text to text.
    """
    raw = text.encode().lower()
    words, hashes = raw.translate(_SPACED).split(), word_hashes(raw, _GAP)
    grams = sliding_hash(hashes, GRAM)
    hit, found = np.zeros(len(words), dtype=bool), set()
    for ident, item in items:
        if item not in memo:
            if len(memo) >= 4096:
                memo.clear()
            memo[item] = _windows(item)
        n, windows, prints = memo[item]
        if not n or n > len(words):
            continue
        hashed, reach = (grams, WINDOW - GRAM) if n == WINDOW else (short_grams(hashes, n), 0)
        places = np.flatnonzero(np.isin(hashed, prints))
        starts = np.unique((places[:, None] - np.arange(reach + 1)[None, :]).ravel())
        for start in starts[(starts >= 0) & (starts <= len(words) - n)].tolist():
            if tuple(words[start:start + n]) in windows:
                hit[start:start + n] = True
                found.add(ident)
    return int(hit.sum()), [x for x in found if x is not None]


def _extend_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict = {}
    for batch in batches:
        total, hits, items, names = [], [], [], []
        for text, near in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            total.append(len(text.encode().lower().translate(_SPACED).split()))
            n, found = extend(text, [(x["name"], x["text"]) for x in near], memo) if near else (0, [])
            hits.append(n)
            items.append(len(found))
            names.append(hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
        counts = [pa.array(x, pa.int64()) for x in (total, hits, items)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(names, pa.string()), pa.array([n > 0 for n in hits], pa.bool_())],
                                         names=["lineage", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def shared_with_projection(discovery: DataFrame, projection: DataFrame) -> DataFrame:
    """Which texts of ``discovery(lineage, genes)`` repeat windows of ``projection(lineage, genes)``, so that a fit would see what it is
    later tested on.

    Words are runs of ASCII letters, digits and non-ASCII characters, ASCII lower-cased. A window is ten consecutive words of a projection
    text; one with fewer words, but not none, is one window. Returns ``lineage, n_words, n_hit, n_items, items_sha256, contaminated``:
    words of the text, those inside any occurrence of a window, projection texts (by lineage) with occurring windows, the sha256 of
    their sorted names joined by commas, and whether any word is hit.

    Both sides keep the smallest 5-gram hash of each window (winnowing); the fingerprints are joined, a broadcast if Spark measures the
    projection side small and a shuffle otherwise. Texts of matching pairs are then extended from the shared places, word by word, so
    nothing rests on hashes alone and every shared window is found.

    Null or empty texts have no words and no hits; null lineages keep their rows, and a projection text without a lineage marks words but
    isn't counted. Repeated rows are judged each on its own. An empty side gives no hits; extra columns are left out.
    """
    rows = signature_rows(discovery)
    kind = rows.schema["lineage"].dataType.simpleString()
    items = keep(signature_rows(projection).select(F.monotonically_increasing_id().alias("item"), F.col("lineage").cast("string").alias("name"),
                                                   F.col("genes").alias("text")))
    n_words = F.size(F.filter(F.split(F.lower("text"), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != ""))
    short = sorted(r.n for r in items.select(n_words.alias("n")).filter((F.col("n") > 0) & (F.col("n") < WINDOW)).distinct().collect())
    wanted = (items.select("item", "text").mapInArrow(_print_columns(None), "item long, prints array<long>")
              .select("item", F.explode("prints").alias("print")))
    prints = (rows.mapInArrow(_print_columns(short), f"lineage {kind}, prints array<long>")
              .select("lineage", F.explode("prints").alias("print")))
    pairs = prints.join(wanted, "print").select("lineage", "item").distinct()
    near = keep(pairs.join(items, "item").groupBy(F.col("lineage").alias("_lineage"))
                .agg(F.collect_list(F.struct("name", "text")).alias("items")))
    joined = rows.join(near.hint("merge"), F.col("lineage").eqNullSafe(F.col("_lineage")), "left").select("lineage", "genes", "items")
    return joined.mapInArrow(_extend_columns, f"lineage {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
