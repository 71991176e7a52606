"""Runs of periodically repeated genes in signature texts, found online along diagonals."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.llm.common import few_rows, gaps, signature_rows, sliding_hash, word_hashes

#: Shortest run. A run of period q has at least ``max(SHORTEST, 2 * q)`` words.
SHORTEST = 12
#: Every run has a diagonal of at least so many equal words: ``length - q >= SHORTEST / 2``. So diagonals are followed over groups of so many words.
GROUP = SHORTEST // 2
_GAP = gaps("space")


class Diagonals:
    """State of the online scan: places of each group of words, and the lags whose diagonals are being matched.

    ``step`` takes the next place. Lags that match on are kept, those that end are emitted if their diagonal is long enough, and earlier
    occurrences of the group open new ones. Inside a stretch whose period ``p`` is settled (its diagonal has at least ``p`` matches), no
    run begins at a longer lag within the stretch: multiples of ``p`` repeat it, and others end before they are long enough or are met again
    when the stretch ends. So occurrences inside the stretch beyond ``p`` are passed over, and a new diagonal is first followed back to where
    it begins. That keeps a word repeated a thousand times from opening half a million diagonals.
    """

    def __init__(self, groups: list[int]) -> None:
        self.groups, self.places, self.active = groups, defaultdict(list), {}

    def ended(self, at: int) -> Iterator[tuple[int, int, int]]:
        """``(first match, place after the last, lag)`` of diagonals that don't go on at ``at``, those that are long enough."""
        groups = self.groups
        here = groups[at] if at < len(groups) else -1
        for lag in [lag for lag in self.active if here < 0 or groups[at - lag] != here]:
            first = self.active.pop(lag)
            matched = at - first + GROUP - 1
            if matched >= max(lag, SHORTEST - lag):
                yield first, at, lag

    def open(self, at: int) -> None:
        groups, active = self.groups, self.active
        here = groups[at]
        if here < 0:
            return
        settled = [(lag, first - lag) for lag, first in active.items() if at - first + GROUP >= lag] if active else []
        places = self.places[here]
        i = len(places)
        while i:
            lag = at - places[i - 1]
            start = min((s for p, s in settled if p < lag), default=at)
            if places[i - 1] >= start:
                i = bisect_left(places, start, 0, i)
                continue
            i -= 1
            if lag not in active:
                first = at
                while first - lag > 0 and groups[first - 1] >= 0 and groups[first - 1] == groups[first - 1 - lag]:
                    first -= 1
                active[lag] = first
        places.append(at)


def repeated_groups(words: list[bytes], text: bytes) -> list[int]:
    """A number for each group of ``GROUP`` words from its place on, equal for equal groups; -1 if it stands nowhere else."""
    hashes = sliding_hash(word_hashes(text, _GAP), GROUP)
    _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    out, names = [-1] * len(hashes), {}
    for i in np.flatnonzero(counts[inverse] > 1).tolist():
        out[i] = names.setdefault(tuple(words[i:i + GROUP]), len(names))
    return out


def runs_of(text: bytes) -> tuple[list[bytes], list[tuple[int, int, int]]]:
    """The words, and ``(start, length, period)`` of all runs by start, then period."""
    words = text.split()
    groups = repeated_groups(words, text) if len(words) >= SHORTEST else []
    scan, found = Diagonals(groups), {}
    for at in range(len(groups) + 1) if any(g >= 0 for g in groups) else ():
        for first, after, lag in scan.ended(at):
            span = (first - lag, after + GROUP - 1)
            found[span] = min(lag, found.get(span, lag))
        if at < len(groups):
            scan.open(at)
    return words, sorted((start, end - start, lag) for (start, end), lag in found.items())


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in few_rows(batches):
        counts, runs, collapsed = [], [], []
        for text in batch.column(1).to_pylist():
            words, found = runs_of(text.encode())
            counts.append(len(words))
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
            drop = np.zeros(len(words) + 1, dtype=np.int64)
            for s, n, q in found:
                drop[s + q] += 1
                drop[s + n] -= 1
            stays = (np.cumsum(drop)[:-1] == 0).tolist()
            collapsed.append(b" ".join(w for w, s in zip(words, stays, strict=True) if s).decode() if found else b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(collapsed, pa.string())],
                                         names=["lineage", "n_genes", "runs", "collapsed"])


def repeated_gene_runs(signatures: DataFrame) -> DataFrame:
    """Where the texts of ``signatures(lineage, genes)`` repeat themselves word after word, as a list pasted several times does.

    Words are what white space separates, numbered from 0. A run is a stretch of consecutive words with smallest period q (words q apart are
    identical) and at least ``max(12, 2 * q)`` words that no neighbouring word extends with that period. Returns ``lineage, n_genes, runs,
    collapsed``: the number of words, all runs as ``(start, length, period)`` by start, then period, and the words joined by one blank less those
    that a run holds after its first q.

    The method is an online scan along diagonals: earlier occurrences of what stands here make the match lengths of their lags grow, and a
    diagonal that ends is emitted at once if it is long enough. As every run has at least six equal words in a row on its diagonal, an occurrence
    is one of a word with its five followers: few words take part in texts that repeat nothing, and memory is a few numbers per word. Groups are
    compared word by word; hashes only pass over those that stand once. Equal stretches at several lags are one run of the smallest lag.

    Each text is scanned on its own, so there is no shuffle and no hot key. Null and empty texts have no words and no runs; very long texts
    and texts of one word repeated are scanned whole; rows that repeat or lack a lineage are judged each on its own. An empty table gives an empty
    result; extra columns are left out.
    """
    rows = signature_rows(signatures)
    kind = rows.schema["lineage"].dataType.simpleString()
    return rows.mapInArrow(_columns, f"lineage {kind}, n_genes long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def longest_run(runs: str = "runs"):
    """Of an array of runs the longest; ties: smallest start, then period. Null if there is none."""
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(F.size(runs) > 0, F.struct(best["start"].alias("start"), (-best["length"]).alias("length"), best["period"].alias("period")))
