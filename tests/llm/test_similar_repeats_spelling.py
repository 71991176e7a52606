"""Most similar cells, repeated gene runs and spelling variants against plain versions."""

import random
from collections import Counter

import numpy as np
import plain_versions as plain
import pytest
from pyspark.sql import functions as F

from cellweft.llm import queries, similar, spelling
from cellweft.llm.repeats import longest_run, repeated_gene_runs, runs_of
from cellweft.llm.similar import most_similar_cells
from cellweft.llm.spelling import gene_spelling_variants


def plain_similar(rows, k):
    whole = []
    for i, (sample, cell, vec) in enumerate(rows):
        if vec and all(x is not None and np.isfinite(x) for x in vec):
            whole.append((i, sample, cell, np.floor(np.array(vec) * 256)))
    out = []
    for i, sample, cell, vec in whole:
        if cell is None or cell % 5:
            continue
        others = [(-int(vec @ v), c is None, c or 0, s is None, s or "") for j, s, c, v in whole if j != i and len(v) == len(vec)]
        out += [(sample, cell, r + 1, None if o[3] else o[4], None if o[1] else o[2], -o[0]) for r, o in enumerate(sorted(others)[:k])]
    return Counter(out)


@pytest.mark.parametrize("fanout,leaf", [(64, 1024), (4, 20)])
def test_most_similar_cells(spark, monkeypatch, fanout, leaf):
    """One page, or a tree of several levels; a crowd of equal vectors, ties, repeated and missing ids, other sizes, broken vectors."""
    monkeypatch.setattr(similar, "FANOUT", fanout)
    monkeypatch.setattr(similar, "LEAF", leaf)
    monkeypatch.setattr(similar.build_tree, "__defaults__", (fanout, leaf))
    rng = np.random.default_rng(3)
    rows = [("a" if i % 3 else "b", i, [float(x) for x in rng.normal(size=4) + 3 * (i % 4)]) for i in range(150)]
    rows += [("a", 200 + i, [1.0, 2.0, 0.5, 0.25]) for i in range(90)] + [("b", 200, [1.0, 2.0, 0.5, 0.25]), ("a", 5, [0.1, 0.2, 0.3, 0.4])]
    rows += [("a", None, [9.0, 9.0, 9.0, 9.0]), (None, 300, [9.0, 9.0, 9.0, 9.0]), ("c", 305, None), ("c", 310, []), ("c", 315, [1.0, None, 2.0, 3.0])]
    rows += [("c", 320, [1.0, float("nan"), 2.0, 3.0]), ("c", 325, [float("inf"), 1.0, 1.0, 1.0]), ("d", 330, [1.0, 2.0]), ("d", 331, [2.0, 1.0]), ("d", 335, [0.0, 0.0])]
    cells = spark.createDataFrame(rows, "sample_id string, cell_id long, vec array<double>").withColumns({"row": F.lit(1), "node": F.lit("x"), "limit": F.lit(2)})
    got = Counter(tuple(r) for r in most_similar_cells(cells, F.col("cell_id") % 5 == 0, 4).collect())
    assert got == plain_similar(rows, 4)


def test_few_or_no_cells(spark):
    schema = "sample_id string, cell_id long, vec array<float>"
    assert most_similar_cells(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    assert most_similar_cells(spark.createDataFrame([("a", 1, [1.0])], schema), F.lit(True)).count() == 0
    assert most_similar_cells(spark.createDataFrame([("a", 1, [1.0]), ("a", 2, [0.5])], schema), F.lit(False)).count() == 0


def test_bounds_save_products(spark, monkeypatch):
    """Where cells lie in few dimensions products are passed over, and nothing is lost."""
    monkeypatch.setattr(similar.build_tree, "__defaults__", (16, 64))
    rng = np.random.default_rng(8)
    rows = [("a", i, [float(x) for x in rng.normal(size=2) * 5]) for i in range(3000)]
    report = []
    cells = spark.createDataFrame(rows, "sample_id string, cell_id long, vec array<double>")
    got = most_similar_cells(cells, F.col("cell_id") % 50 == 0, 5, report=report).collect()
    v = np.floor(np.array([r[2] for r in rows]) * 256)
    for r in got:
        scores = v @ v[r.cell_id]
        scores[r.cell_id] = -np.inf
        assert r.score == np.sort(scores)[-r.rank]
    assert len(got) == 300 and sum(r[0] or 0 for r in report) < 60 * 3000


def plain_runs(words):
    spans = {}
    for q in range(1, len(words) // 2 + 1):
        i = q
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                spans[(i - q, j)] = min(q, spans.get((i - q, j), q))
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in spans.items())


def noisy_repeats(rnd):
    words, alphabet = [], "abcd"[:rnd.choice([1, 2, 2, 3, 4])]
    while len(words) < rnd.randint(1, 90):
        words += [rnd.choice(alphabet) for _ in range(rnd.randint(1, 9))] * rnd.choice([1, 1, 2, 3, 5, 8])
    words = words[:40] * 3 if rnd.random() < 0.3 else words
    for _ in range(3 if rnd.random() < 0.3 else 0):
        words[rnd.randrange(len(words))] = rnd.choice(alphabet)
    return words


def test_runs_equal_plain_search():
    rnd = random.Random(1)
    for _ in range(1500):
        words = noisy_repeats(rnd)
        assert runs_of(" ".join(words).encode())[1] == plain_runs(words), words


def test_repeated_gene_runs(spark):
    rnd = random.Random(2)
    texts = [" ".join(noisy_repeats(rnd)) for _ in range(60)] + [None, "", " \t\n", "É " * 40, "x" * 100_000, "a " * 60_000, ("p q r " * 30_000)[:-1]]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] * 2
    got = repeated_gene_runs(spark.createDataFrame(rows, "lineage long, genes string").withColumns({"runs": F.lit(1), "collapsed": F.lit("x")}))
    got = got.withColumn("best", longest_run()).collect()
    want = Counter()
    for lineage, t in rows:
        words = plain.WORD.findall(t or "")
        runs = plain_runs(words) if len(words) < 1000 else [(0, len(words), 1 if "a" in words else 3)]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        want[(lineage, len(words), tuple(runs), " ".join(w for i, w in enumerate(words) if i not in gone), best and (best[1], -best[0], best[2]))] += 1
    assert Counter((r.lineage, r.n_genes, tuple(map(tuple, r.runs)), r.collapsed, r.best and tuple(r.best)) for r in got) == want
    assert repeated_gene_runs(spark.createDataFrame([], "lineage long, genes string")).count() == 0


def plain_variants(rows, least=3):
    n = Counter()
    for gene, count in rows:
        if gene is not None and len(gene) >= 5 and count is not None:
            n[gene] += count
    n = {g: c for g, c in n.items() if c >= least}
    less = {}
    for g in n:
        for i in range(len(g)):
            less.setdefault((i, g[:i] + g[i + 1:]), set()).add(g)
    near = {g: set() for g in n}
    for g in n:
        for i in range(len(g)):
            rest = g[:i] + g[i + 1:]
            near[g] |= less[(i, rest)] - {g}
            if rest in n:
                near[g].add(rest)
                near[rest].add(g)
    form = {}
    for g in n:
        best = min(near[g], key=lambda x: (-n[x], x), default=None)
        form[g] = best if best is not None and n[best] >= 2 * n[g] else None
    out = set()
    for g in n:
        root = g
        while form[root]:
            root = form[root]
        out.add((g, form[g], root, n[g], len(near[g]), n[form[g]] if form[g] else None))
    return out


@pytest.mark.parametrize("places,slots", [(4096, 1 << 18), (16, 64), (1, 1)])
def test_gene_spelling_variants(spark, monkeypatch, places, slots):
    """Pruned dictionaries of any size and lists counted together give the same links."""
    monkeypatch.setattr(spelling, "PLACES", places)
    monkeypatch.setattr(spelling, "SLOTS", slots)
    rnd = random.Random(4)
    rows = []
    for _ in range(250):
        gene = "".join(rnd.choice("abé") for _ in range(rnd.randint(4, 9)))
        rows.append((gene, rnd.choice([1, 3, 4, 9, 20, 100, 300])))
        for _ in range(rnd.randint(0, 3)):
            i, kind = rnd.randrange(len(gene) + 1), rnd.randrange(3)
            rows.append((gene[:i] + (rnd.choice("abéz") if kind else "") + gene[i + (kind != 1):], rnd.randint(1, 30)))
    rows += [(None, 5), ("", 9), ("abcde", None), ("x" * 3000, 7), ("x" * 2999, 70), ("x" * 2998, 700), ("ALB-1", 3), ("ALB-2", 6), ("ALB-10", 12), ("ALB-1", 2)]
    got = gene_spelling_variants(spark.createDataFrame(rows, "gene string, n int").withColumns({"near": F.lit(1), "size": F.lit("x")})).collect()
    assert len(got) == len(set(got)) and {(r.gene, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == plain_variants(rows)
    assert gene_spelling_variants(spark.createDataFrame([], "gene string, n int")).count() == 0


def test_one_edit_affects_one_of_two_grams():
    lengths = np.arange(spelling.SLOTS)
    rnd = random.Random(5)
    for _ in range(300):
        gene = "".join(rnd.choice("abc") for _ in range(rnd.randint(5, 30)))
        found = spelling.grams(gene, {"ab", "abc", "abca", "bc"})
        pair = spelling.cheapest_lists(found, len(gene), lengths)
        assert spelling.affected([(i, len(found[i])) for i in pair]) == 1
    with pytest.raises(ValueError):
        gene_spelling_variants(None, min_length=4)


def test_queries_on_nulls(spark):
    docs = spark.createDataFrame([(0, None), (None, "a b c"), (7, "one"), (110, "a b c d e f g h"), (3, "")], "doc_id long, text string")
    assert queries.with_repeats(docs).count() == 5
    assert {r.gene for r in queries.misspelt_names(docs).collect()} <= set("abcdefgh") | {"one", "", "ne", "oe", "on"}
