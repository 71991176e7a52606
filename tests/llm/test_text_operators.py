"""Personal data, licences, mixing, quality, language model and shards."""

import math
import random
from collections import Counter

import numpy as np
import plain_versions as plain
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellweft.llm import identifiers, language
from cellweft.llm.identifiers import personal_identifiers
from cellweft.llm.language import score_signatures
from cellweft.llm.licences import file_licences
from cellweft.llm.mixing import dataset_targets, mix_datasets
from cellweft.llm.quality import NAMES, signature_quality, tree_rules, with_statistics
from cellweft.llm.queries import VOCABULARY
from cellweft.llm.training_order import Feistel, Tokens, open_folder, read_slots, write_training_order

PATHS = [
    "/data/ann.lee@lab-7.example.org/run.1.h5ad", "mail a.b@c.d@e.f.g, x@y", "host 10.0.0.255 and 10.0.0.256 and 1.2.3.4.5.6.7.8", "001.002.003.004",
    "card 4539 1488 0343 6467, 4539148803436468; 4539-1488-0343-6467-1", "+1 (269) 555-3296 45241322646528", "+1 (269) 555-3296", "+12 3", "é +44 20 7946 0958é",
    None, "", "0" * 9000, "a" * 9000 + "@", "1." * 4000, "+1" + "(" * 4000 + "2", "a@b.c_d@e.f", "x" * 30 + "@y", "😀 ann@x.org 😀 9.9.9.9"]


def rows_of(spark, rows, schema, **more):
    return spark.createDataFrame(rows, schema).withColumns({k: F.lit(v) for k, v in more.items()})


def test_base_identifiers(spark):
    rows = [(i, p) for i, p in enumerate(PATHS)] + [(None, PATHS[0]), (1, PATHS[1])]
    got = personal_identifiers(rows_of(spark, rows, "sample_id long, filepath string", row=1, kind="x", parts=2)).collect()
    assert len(got) == len(rows)
    want = Counter((i, ",".join(plain.base_spans(p))) for i, p in rows)
    assert Counter((r.sample_id, r.spans) for r in got) == want
    for r in got:
        kinds = Counter(s.split(":")[0] for s in r.spans.split(",") if s)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_learnt) == (*[kinds[k] for k in identifiers.KINDS], 0)
        assert r.base_sha256 == plain.sha(r.spans)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="a1@. +-(9é\n%_", max_size=60), min_size=30, max_size=120))
def test_base_identifiers_in_noise(spark, texts):
    got = personal_identifiers(spark.createDataFrame(list(enumerate(texts)), "sample_id long, filepath string")).collect()
    for r in got:
        assert r.base_sha256 == plain.sha(",".join(plain.base_spans(texts[r.sample_id]))), texts[r.sample_id]


def test_learnt_identifiers(spark):
    """Phones without a plus sign stand where phones stand; numbers elsewhere stay."""
    rows = [(i, f"patient phone: +1 (269) 555-{3000 + i} ward {i}") for i in range(12)]
    rows += [(100, "patient phone: 269-555-7777 ward 9"), (101, "batch 269-555-7777 done"), (102, "lane 2695557777"), (103, "patient phone: n/a")]
    got = {r.sample_id: r for r in personal_identifiers(spark.createDataFrame(rows, "sample_id long, filepath string")).collect()}
    assert got[100].spans == "phone:15:27" and got[100].n_learnt == 1 and got[100].n_phone == 0 and got[100].base_sha256 == plain.sha("")
    assert [got[i].spans for i in (101, 102, 103)] == ["", "", ""]
    assert all(got[i].n_learnt == 0 for i in range(12))


def test_file_licences(spark):
    rows = [
        (1, "atlas/lung/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                                  "documentation files, to deal in the Software without restriction."),
        (2, "atlas/lung/a/b/cells.h5ad", "counts"), (3, "atlas/skin/cells.h5ad", "counts"), (4, "atlas/COPYING.txt", "Licensed under the Apache License, Version 2.0."),
        (5, "atlas/lung/x.py", "# Licensed under CC BY-NC 4.0.\nimport x"), (6, "atlas/lung/y.py", "A licence to be silly is granted to all who like terms of art."),
        (7, None, "Some text. This work is licensed under the GNU General Public License, version 3. More text."), (8, "top.txt", None), (None, "atlas/z", ""),
        (9, "atlas/two.txt", "Released under the MIT License.\n" + "word " * 50_000 + "\nLicensed under the Apache License, Version 2.0."),
        (10, "other/LICENSE", "no rights told"), (11, "other/q", "x"), (5, "atlas/lung/x.py", "# Licensed under CC BY-NC 4.0.\nimport x")]
    got = file_licences(rows_of(spark, rows, "sample_id long, filepath string, header string", row=7, segment="s", licence="x", folder=1)).collect()
    found = Counter((r.sample_id, r.licence, r.licences, r.origin) for r in got)
    assert found == Counter([
        (1, "MIT", "MIT", "file"), (2, "MIT", "MIT", "inherited"), (3, "Apache-2.0", "Apache-2.0", "inherited"), (4, "Apache-2.0", "Apache-2.0", "file"),
        (5, "CC-BY-NC-4.0", "CC-BY-NC-4.0", "header"), (5, "CC-BY-NC-4.0", "CC-BY-NC-4.0", "header"), (6, "MIT", "MIT", "inherited"), (7, "GPL-3.0", "GPL-3.0", "header"),
        (8, None, "", "none"), (None, "Apache-2.0", "Apache-2.0", "inherited"), (9, "Apache-2.0", "Apache-2.0,MIT", "header"), (10, None, "", "none"),
        (11, None, "", "none")])
    assert file_licences(spark.createDataFrame([], "sample_id long, filepath string, header string")).count() == 0


def filled(sizes, shares, ratio=1.5, cap=2.0):
    """Targets by sharing out again and again."""
    target, full, left = {}, set(), ratio * sum(sizes.values())
    while True:
        open_ = [k for k in sizes if k not in full]
        total = sum(shares[k] for k in open_)
        over = [k for k in open_ if left * shares[k] / total > cap * sizes[k]]
        if not over:
            return {**target, **{k: left * shares[k] / total for k in open_}}
        for k in over:
            target[k] = cap * sizes[k]
            full.add(k)
        left = ratio * sum(sizes.values()) - sum(target.values())


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_targets(spark, sizes):
    names = [f"d{i}" for i in range(len(sizes) - 1)] + [None]
    cells = spark.createDataFrame([(n, s, 1.0) for n, s in zip(names, sizes, strict=True)], "dataset_id string, total long, weight double")
    got = {r.dataset_id: r.target for r in dataset_targets(cells).collect()}
    want = filled(dict(zip(names, sizes, strict=True)), {n: (5.0, 2.0, 1.0)[i % 3] for i, n in enumerate(names)})
    assert got == pytest.approx(want)


def test_mix_datasets(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["A", "B", "b", None]), i, rng.choice([0, 1, 5, 400]), rng.choice([None, 0.5, 1.0, 2.0, 0.0])) for i in range(900)]
    rows += [("A", 1, 7, 1.0), ("A", 1, 7, 1.0), (None, None, 3, 1.0), ("B", 5000, None, 1.0), ("B", 5001, -4, 1.0)]
    cells = rows_of(spark, rows, "dataset_id string, cell_id long, total long, weight double", _key=1, target=2, taken=3)
    got = mix_datasets(cells, part_rows=20).collect()
    assert len(got) == len(rows)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mix_datasets(cells.repartition(7), part_rows=10_000).collect()))
    by = {}
    for r in got:
        by.setdefault(r.dataset_id, []).append(r)
    for dataset, members in by.items():
        target, size = members[0].target, members[0].source_size
        assert size == sum(r.total for r in members) == sum(max(x[2] or 0, 0) for x in rows if x[0] == dataset)
        assert abs(sum(r.taken for r in members) - target) <= 1
        assert all(0 <= r.taken <= 2 * r.total for r in members)
        epochs = int(target // size)
        assert sum(0 < r.taken - epochs * r.total < r.total for r in members) <= 1
    assert mix_datasets(cells.limit(0)).count() == 0


def test_heavier_cells_are_drawn_sooner(spark):
    cells = spark.range(4000).select(F.when(F.col("id") < 2000, "A").otherwise("B").alias("dataset_id"), F.col("id").alias("cell_id"), F.lit(10).alias("total"),
                                     F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("weight"))
    got = mix_datasets(cells, shares=(1.0,), ratio=0.25).filter("taken = total").groupBy((F.col("cell_id") % 2).alias("odd")).count().collect()
    counts = {r.odd: r["count"] for r in got}
    assert 2.5 * counts[1] < counts[0] < 4.5 * counts[1]


def test_quality_rules(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(["CD8A", "sox2", "vim", "Lum"]) + "ab" * rng.randrange(3) for _ in range(rng.randrange(5, 60))]
        good = rng.random() < 0.5
        rows.append((i, " ".join(words) if good else "!! ".join(w.upper() for w in words)))
        if i % 3:
            labels.append((i, int(good)))
    rows += [(9000, None), (9001, ""), (9002, "x" * 200_000), (None, "CD8A"), (0, rows[0][1])]
    labels += [(1, None), (77777, 1), (None, 1)]
    signatures = rows_of(spark, rows, "lineage long, genes string", label=1, log_chars=2.0, _words="q", score=0.1)
    known = rows_of(spark, labels, "lineage long, label int", score=1)
    got = signature_quality(signatures, known).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = {r.lineage: r.score for r in got if r.lineage is not None and r.lineage < 600 and r.lineage % 3 == 0}
    right = sum((held[i] >= 0.5) == ("!!" not in t) for i, t in rows[:600] if i % 3 == 0)
    assert right >= 0.98 * len(held)
    few = signature_quality(signatures.limit(5), known.limit(0)).collect()
    assert {round(r.score, 6) for r in few} == {0.5}
    ones = signature_quality(signatures.limit(50), known.filter("label = 1")).collect()
    assert all(r.score > 0.9 for r in ones)
    assert signature_quality(signatures.limit(0), known).count() == 0


def test_statistics_are_never_null(spark):
    stats = with_statistics(spark.createDataFrame([(1, ""), (2, "a\n\na  B1!")], "lineage long, genes string")).collect()
    assert all(r[n] is not None for r in stats for n in NAMES)
    assert (stats[1].distinct_words, stats[1].distinct_lines) == (2 / 2, 2 / 2) or stats[1].distinct_words == 2 / 3


def test_tree_paths():
    text = "Tree\n  If (feature 0 <= 0.5)\n   If (feature 1 <= 2.0)\n    Predict: 0.0\n   Else (feature 1 > 2.0)\n    Predict: 1.0\n  Else (feature 0 > 0.5)\n   Predict: 1.0\n"
    assert tree_rules(text, ["a", "b"]) == {(("a", False, 0.5),), (("a", True, 0.5),), (("a", False, 0.5), ("b", False, 2.0)), (("a", False, 0.5), ("b", True, 2.0))}


def plain_score(rows, known_words):
    """Counts and base scores of all rows ``(lineage, genes, is_train)``."""
    tokens = lambda t: [*plain.WORD.findall((t or "").translate(plain.UPPER)), None]
    seen = Counter(w for _, t, train in rows if train for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    return Counter((i, bool(train), len(tokens(t)), sum(seen[w] > 0 for w in tokens(t)), n,
                    round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t, train in rows)


@pytest.fixture(scope="module")
def told(spark):
    rng = random.Random(8)
    names = [f"gene{i}" for i in range(400)]
    rows = []
    for i in range(500):
        words, at = [], rng.randrange(400)
        for _ in range(rng.randrange(1, 50)):
            at = (at * 3 + 1) % 400 if rng.random() < 0.7 else min(int(rng.expovariate(0.03)), 399)
            words.append(names[at])
        rows.append((i, " ".join(words), i % 7 != 2))
    return [*rows, (900, None, True), (901, "", False), (902, "NEVER seen BEFORE", False), (None, "gene1 GENE1", None), (3, rows[3][1], True), (903, "gene5 " * 30_000, False)]


@pytest.mark.parametrize("known_words", [60, 1 << 18])
def test_language_model(spark, told, known_words):
    rows = rows_of(spark, told, "lineage long, genes string, is_train boolean", row=1, word="w", c=2, score=9.0)
    got = score_signatures(rows, known_words).collect()
    assert Counter((r.lineage, r.is_train, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == plain_score(told, known_words)
    held = [r for r in got if r.lineage is not None and r.lineage < 500 and not r.is_train]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.05 * abs(sum(r.base_score for r in held))
    assert all(r.score < 0 for r in got)


def test_scores_do_not_depend_on_what_tasks_know(spark, told):
    rows = spark.createDataFrame(told, "lineage long, genes string, is_train boolean")
    few, many = ({(r.lineage, r.n_tokens): r.score for r in score_signatures(rows, n, rounds=3).collect()} for n in (300, 1 << 18))
    assert few == pytest.approx(many)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    weights = language.Weights(*[rng.normal(size=w.shape) for w in language.Weights.zero().parts()])
    context = np.arange(0, language.CLASSES ** 2, 501)
    assert np.allclose(np.exp(weights.log_softmax(context)).sum(axis=1), 1)
    words = [language.END, *[f"w{i}".encode() for i in range(300)]]
    counts = rng.integers(1, 50, len(words)).astype(float)
    vocabulary = language.Vocabulary(words, counts)
    at = vocabulary.classes()[:len(words)]
    for i, weight in enumerate((counts, np.ones(len(words)), (counts == 1).astype(float))):
        np.add.at(vocabulary.sums[i], at, weight)
    shares = np.bincount(at, 10 ** vocabulary.log_in_class(counts, at), language.CLASSES) + vocabulary.unseen()
    assert np.allclose(shares, 1)


def test_language_model_without_rows(spark):
    none = spark.createDataFrame([], "lineage long, genes string, is_train boolean")
    assert score_signatures(none, rounds=1).count() == 0
    only = score_signatures(spark.createDataFrame([(1, "a b", False)], "lineage long, genes string, is_train boolean"), rounds=1).first()
    assert (only.n_tokens, only.n_known, only.train_tokens, only.base_score) == (3, 0, 0, 0.0)
    assert only.score == pytest.approx(3 * math.log10(1 / language.CLASSES))


@pytest.mark.parametrize("size", [1, 2, 3, 17, 256, 1000, 4097])
def test_feistel_is_a_permutation(size):
    order = Feistel(size, 99)(np.arange(size))
    assert sorted(order) == list(range(size))
    assert size < 100 or list(order) != list(range(size))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é\n\t'1.,s  ñ😀  "), max_size=40))
def test_pieces_encode_like_whole_texts(text):
    assert TOKENS.of(text) == np.array(TOKENS.encoding.encode_ordinary(text), dtype="<u2").tobytes()


TOKENS = Tokens(VOCABULARY)


def test_training_order_round_trip(spark, tmp_path):
    rng = random.Random(6)
    texts = [(i, " ".join(rng.choice(["CD8A", "vim", "ñandú", "sox2,", "\n\n a"]) for _ in range(rng.randrange(0, 90)))) for i in range(300)]
    texts += [(1000, None), (1001, ""), (1002, "lum " * 20_000), (None, "no name"), (5, texts[5][1])]
    rows = rows_of(spark, texts, "lineage long, genes string", slot=1, part=2, tokens="t").repartition(5)
    out = f"file:{tmp_path}/shards"
    placed = [r.asDict() for r in write_training_order(rows, VOCABULARY, out, stride=64, shard_rows=32).collect()]
    slots = 1 + max(r["slot"] for r in placed)
    tokens = read_slots(out, 0, slots, stride=64, shard_rows=32)
    assert {r["slot"] for r in placed} == set(range(slots)) and all(r["shard"] == r["slot"] // 32 for r in placed)
    encoding, end = TOKENS.encoding, int(np.frombuffer(TOKENS.end, "<u2")[0])
    assert isinstance(encoding, tiktoken.Encoding)
    filled = np.zeros(tokens.shape, dtype=bool)
    pieces = {}
    for r in placed:
        span = slice(r["position"], r["position"] + r["n_tokens"])
        assert not filled[r["slot"], span].any()
        filled[r["slot"], span] = True
        pieces.setdefault((r["lineage"], r["start"]), []).append(tokens[r["slot"], span].tolist())
    want = {}
    for name, text in texts:
        want.setdefault(name, []).append([*encoding.encode_ordinary(text or ""), end])
    for name, wanted in want.items():
        starts = sorted(s for n, s in pieces if n == name)
        if len(wanted) == 1:
            assert sum((pieces[name, s][0] for s in starts), []) == wanted[0]
        else:
            assert sum(len(p) for s in starts for p in pieces[name, s]) == sum(map(len, wanted))
    assert (tokens[~filled] == end).all()
    files, folder = open_folder(out)
    sizes = {i.base_name: i.size for i in files.get_file_info(__import__("pyarrow").fs.FileSelector(folder))}
    assert all(n.endswith(".bin") for n in sizes) and sum(sizes.values()) == slots * 128
    again = f"{tmp_path}/again"
    write_training_order(rows, VOCABULARY, again, stride=64, shard_rows=32)
    assert (read_slots(again, 5, 7, stride=64, shard_rows=32) == tokens[5:12]).all()
    assert write_training_order(rows.limit(0), VOCABULARY, f"{tmp_path}/none").count() == 0
