"""Personal data in manifest text: patterns first, then contexts learnt from what they find. Only column functions are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.llm.common import drop_table, keep

KINDS = ("email", "ip", "card", "phone")
#: What an identifier looks like. Possessive groups and the guards in front change no match; they keep long runs linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold before a pattern is tried on it.
HINTS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9]", "phone": "\\+[0-9]"}
#: Words that look like an identifier: with a digit or an at sign.
SHAPED = r"(?<!\S)(?=\S*[0-9@])\S++"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_EDGE = "[\\x20-\\x24\\x26-\\x2A,./:;<=>?\\[\\]^`{|}~\"']"

#: Rounds of scoring; distinct seeds that a context needs; confidence of a context and score of an instance to be believed.
ROUNDS, SEEDS, BELIEVED = 3, 3, 0.8


def _matches(kind: str, pattern: str, text: Column, hint: str) -> Column:
    """Matches of a pattern with the length of the text since the last one and the words on both sides.

    ``split`` and ``regexp_extract_all`` walk a text alike, so gap ``i`` stands before match ``i``; start places follow by a running sum.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    word = lambda c, p: F.lower(F.regexp_extract(c, p, 1))
    rows = F.transform(found, lambda m, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), m.alias("m"), F.length(gaps[i]).alias("gap"),
        word(F.substring(gaps[i], -64, 64), r"(\S+)\s*$").alias("left"), word(F.substring(gaps[i + 1], 1, 64), r"^\s*(\S+)").alias("right")))
    empty = F.array().cast("array<struct<kind: string, i: int, m: string, gap: int, left: string, right: string>>")
    return F.when(text.rlike(hint) & (F.regexp_instr(text, F.lit(pattern)) > 0), rows).otherwise(empty)


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes: from the right, every second digit counts double, 9 less if it has two digits."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(
        i % 2 == 1, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _valid(kind: Column, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    return (F.when(kind == "ip", m.rlike(f"^{_BYTE}(?:\\.{_BYTE}){{3}}$")).when(kind == "card", n.between(13, 19) & _luhn(digits))
            .when(kind == "phone", n.between(9, 15)).otherwise(F.lit(True)))


def _could_be(kind: Column, m: Column) -> Column:
    """What an unseen instance of a kind must look like at least."""
    n = F.length(F.regexp_replace(m, "[^0-9]", ""))
    return (F.when(kind == "email", m.rlike("^[^@]+@[^@]+$")).when(kind == "ip", m.rlike("^[0-9]+([.:_-][0-9]+){3,}$"))
            .when(kind == "card", n.between(12, 19) & m.rlike("^[0-9._/-]+$")).otherwise(n.between(7, 15) & m.rlike("^[0-9().+/_-]+$")))


def found_instances(rows: DataFrame) -> DataFrame:
    """``row, kind, m, start, end, left, right`` for each match in ``rows(row, parts)``; ``kind`` is ``shaped`` for mere look-alikes."""
    each = rows.select("row", F.explode("parts").alias("p")).select("row", "p.*")
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("m")).over(before)
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.length("m"))
    base = placed.filter((F.col("kind") != "shaped") & _valid(F.col("kind"), F.col("m")))
    lead = F.length(F.regexp_extract("m", f"^{_EDGE}*", 0))
    core = F.regexp_replace(F.regexp_replace("m", f"^{_EDGE}+", ""), f"(?<!{_EDGE}){_EDGE}++$", "")
    shaped = (placed.filter("kind = 'shaped'").withColumn("start", F.col("start") + lead).withColumn("m", core)
              .withColumn("end", F.col("start") + F.length("m")).filter(F.length("m") > 0))
    names = ["row", "kind", "m", "start", "end", "left", "right"]
    return base.select(*names).unionByName(shaped.select(*names))


def _free_of_base(found: DataFrame) -> DataFrame:
    """Base instances, and those look-alikes that touch none of them."""
    is_base = F.col("kind") != "shaped"
    by_start = Window.partitionBy("row").orderBy("start", "end")
    last_end = F.max(F.when(is_base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    next_start = F.min(F.when(is_base, F.col("start"))).over(by_start.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    touches = (F.coalesce(last_end, F.lit(-1)) > F.col("start")) | (F.coalesce(next_start, F.lit(2 ** 31)) < F.col("end"))
    return found.withColumn("_touches", touches).filter(is_base | ~F.col("_touches")).drop("_touches")


def learnt_instances(found: DataFrame, rounds: int = ROUNDS, seeds: int = SEEDS, believed: float = BELIEVED) -> DataFrame:
    """``row, kind, start, end`` of look-alikes that stand where identifiers of one kind stand.

    A context is the word before or after an instance, or both. Contexts and instances form a graph. In each round the confidence of
    a context for a kind is the mean score of its instances for that kind (base instances have 1 for their kind), counting one doubtful
    instance more; the score of an instance is one less the product of the doubts of its contexts. Contexts with fewer than
    ``seeds`` different base instances of the kind are left out. An occurrence is believed if one of its contexts and its instance both are.
    """
    both = F.concat_ws(" _ ", "left", "right")
    contexts = F.filter(F.array(F.when(F.col("left") != "", F.concat(F.col("left"), F.lit(" _"))), F.when(F.col("right") != "", F.concat(F.lit("_ "), F.col("right"))),
                                F.when((F.col("left") != "") & (F.col("right") != ""), both)), lambda c: c.isNotNull())
    marked = found.withColumn("context", F.explode(contexts))
    seeded = (marked.filter("kind <> 'shaped'").select("context", "kind", "m").distinct().groupBy("context", "kind")
              .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= seeds).select("context", F.col("kind").alias("about")))
    open_contexts = keep(seeded)
    edges = keep(marked.select("context", "kind", "m").distinct().join(open_contexts, "context")
                 .withColumn("seed", (F.col("kind") == F.col("about")).cast("double"))
                 .groupBy("context", "about", "m").agg(F.max("seed").alias("seed"), F.max((F.col("kind") == "shaped").cast("int")).alias("unseen")))
    scores, confidence = None, None
    for _ in range(rounds):
        scored = edges if scores is None else edges.join(scores, ["about", "m"], "left")
        score = F.when(F.col("unseen") == 0, F.col("seed")).otherwise(F.lit(0.0) if scores is None else F.coalesce("score", F.lit(0.0)))
        new = keep(scored.groupBy("context", "about").agg((F.sum(F.greatest("seed", score)) / (F.count(F.lit(1)) + 1)).alias("confidence")))
        if confidence is not None:
            drop_table(confidence)
            drop_table(scores)
        confidence = new
        doubt = F.sum(F.ln(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))
        scores = keep(edges.filter("unseen = 1").join(confidence.filter("confidence >= 0.5"), ["context", "about"])
                      .groupBy("about", "m").agg((1 - F.exp(doubt)).alias("score")))
    unseen = marked.filter("kind = 'shaped'").select("row", "m", "start", "end", "context")
    sure = unseen.join(confidence.filter(F.col("confidence") >= believed), "context").join(scores.filter(F.col("score") >= believed), ["about", "m"])
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("about"))
    return (sure.filter(_could_be(F.col("about"), F.col("m"))).groupBy("row", "start", "end")
            .agg(F.min_by("about", F.struct(-F.col("score"), order)).alias("kind")).select("row", "kind", "start", "end"))


def personal_identifiers(manifest: DataFrame) -> DataFrame:
    """Personal data in the ``filepath`` of ``manifest(sample_id, filepath)``: paths and notes that name people.

    Base spans are leftmost matches of fixed patterns (e-mail, IP address, card number with a right check digit, phone number). From
    their surroundings contexts are learnt over all rows, and words with a digit or at sign that stand in the same contexts are added
    (bootstrapped extraction, see ``learnt_instances``). Base spans stay as they are; added ones never touch them.

    Returns ``sample_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_learnt``: base spans by kind; the sha256 of
    ``kind:start:end`` of base spans in order of kind and start, joined by commas (code points, end exclusive); all spans likewise; how many were added.

    Null text is empty; a row without spans has an empty ``spans``. Repeated rows are rows; null ids are kept; empty tables give
    empty results; extra columns are left out.
    """
    text = F.coalesce(F.col("filepath"), F.lit(""))
    kinds = [_matches(k, PATTERNS[k], F.col("_text"), HINTS[k]) for k in KINDS] + [_matches("shaped", SHAPED, F.col("_text"), "[0-9@]")]
    rows = keep(manifest.select("sample_id", text.alias("_text")).select("sample_id", F.concat(*kinds).alias("parts"))
                .withColumn("row", F.monotonically_increasing_id()))
    found = keep(_free_of_base(found_instances(rows)))
    learnt = learnt_instances(found)
    spans = (found.filter("kind <> 'shaped'").select("row", "kind", "start", "end", F.lit(True).alias("base"))
             .unionByName(learnt.withColumn("base", F.lit(False))))
    order = (F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))).cast("int")
    listed = F.array_sort(F.collect_list(F.struct(order.alias("order"), "start", "end", "kind", "base")))
    counts = [F.count(F.when((F.col("kind") == k) & F.col("base"), 1)).alias(f"n_{k}") for k in KINDS]
    by_row = spans.groupBy("row").agg(listed.alias("all"), *counts, F.count(F.when(~F.col("base"), 1)).alias("n_learnt"))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    none = F.array().cast("array<struct<order: int, start: bigint, end: bigint, kind: string, base: boolean>>")
    joined = rows.select("row", "sample_id").join(by_row, "row", "left").withColumn("all", F.coalesce("all", none))
    return joined.select("sample_id", *[zero(f"n_{k}") for k in KINDS],
                         F.sha2(written(F.filter("all", lambda s: s["base"])), 256).alias("base_sha256"), written(F.col("all")).alias("spans"), zero("n_learnt"))
