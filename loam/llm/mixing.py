"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (native).

A source is read as one stream of words, its documents in digest order, cut into blocks of
``BLOCK_WORDS``. A source's target gives whole passes over its blocks and one partial pass; the
partial pass takes blocks in a permuted order until the target is met, its last block cut to fit.
The block instances of all sources are then dealt to output shards: a binary tree over the shards
draws at each node how many instances of each source go left, which is a multivariate
hypergeometric draw, so each shard's counts are those of a uniform shuffle while every total stays
exact. The leaves' counts are consecutive ranges of each source's permuted instances, hence
disjoint. Each shard is shuffled by itself: its rows are sorted by their random ``slot`` in one task, as
a shard has ``SHARD_WORDS`` words whatever the size of the corpus. Sources are what weights are given to,
up to some thousands: a node of the tree holds a count for each.

Defined results: null text has size 0 and takes 0; a null source is a source of its own, last in
order; repeated rows are separate documents; an empty table gives an empty mix; columns beyond
those named are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.binding import let
from loam.plans.materialize import keep, small_side
from loam.plans.prefix_sums import running_offset

BLOCK_WORDS = 256
SHARD_WORDS = 1_000_000
#: Multipliers of the block permutation: primes above the block count, so x -> a x + c is a bijection mod n; the last
#: one serves sources of more blocks than the others.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
LARGE_PRIME = (1 << 61) - 1


def sized(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, and the digests that order a source's stream."""
    return docs.select(
        "doc_id",
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias("d1"),
        F.md5(F.coalesce(F.col(text), F.lit(""))).alias("d2"),
    )


def targets(rows: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """One row a source: ix, source_size, target, quota (the target in whole words).

    Water filling: with sources by rising cap per weight, the sources before some point get their
    cap and the rest share what is left by weight.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("ix") % len(weights) + 1).cast("int"))
    per = per.withColumn("ix", F.row_number().over(every) - 1).withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "ix")
    whole = Window.partitionBy()
    per = (
        per.withColumn("rn", F.row_number().over(by_ratio))
        .withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left_w", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("lam", (F.lit(share) * F.sum("source_size").over(whole) - F.col("before")) / F.col("left_w"))
    )
    chosen = F.min(F.when(F.col("lam") <= F.col("cap") / F.col("weight"), F.struct("rn", "lam"))).over(whole)["lam"]
    target = F.when(chosen.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), chosen * F.col("weight")))
    return per.withColumn("target", target).select(
        "source", "ix", "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("quota")
    )


def _plan(per: DataFrame, block: int) -> DataFrame:
    """Adds blocks, whole passes, the words of the partial pass and the permutation of each source."""
    n = F.greatest(F.ceil(F.col("source_size") / block), F.lit(1)).cast("long")
    key = F.md5(F.coalesce(F.col("source"), F.lit("-")))
    number = lambda a, b: F.conv(F.substring(key, a, b), 16, 10).cast("long")
    prime = F.element_at(F.array(*[F.lit(x) for x in PRIMES]), (number(1, 2) % len(PRIMES) + 1).cast("int"))
    prime = F.when(F.col("blocks") < min(PRIMES), prime).otherwise(F.lit(LARGE_PRIME))
    last = F.col("source_size") - (F.col("blocks") - 1) * block
    return (
        per.withColumn("blocks", n)
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_size"))
        .withColumn("mul", prime % F.col("blocks"))
        .withColumn("add", number(3, 7) % F.col("blocks"))
        .withColumn("short_at", _permuted(F.col("blocks") - 1))
        .withColumn("short_by", F.lit(block) - last)
        .withColumn("partial", _blocks_for(F.col("rest"), F.col("short_at"), F.col("short_by"), block))
        .withColumn("units", F.when(F.col("source_size") > 0, F.col("passes") * F.col("blocks") + F.col("partial")).otherwise(0).cast("long"))
    )


def _permuted(block: Column) -> Column:
    """(mul * block + add) mod blocks, in two steps so that nothing overflows below 2**40 blocks."""
    a, n, half = F.col("mul"), F.col("blocks"), F.lit(1 << 20)
    high = (a * F.floor(block / half).cast("long")) % n
    return (high * half + a * (block % half) + F.col("add")) % n


def _blocks_for(rest: Column, short_at: Column, short_by: Column, block: int) -> Column:
    """Blocks that the partial pass touches; the short block makes it one more at most."""
    plain = F.ceil(rest / block).cast("long")
    return F.when(short_at < plain, F.ceil((rest + short_by) / block).cast("long")).otherwise(plain)


def _hypergeometric(u: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """How many of ``drawn`` out of ``total`` are among the ``marked``: inversion at ``u``.

    Weights follow the ratio of neighbouring probabilities from 10 standard deviations below the mode.
    """
    t, k, n = total.cast("double"), marked.cast("double"), drawn.cast("double")
    low, high = F.greatest(F.lit(0.0), n + k - t), F.least(n, k)
    mode = F.floor((n + 1) * (k + 1) / (t + 2)).cast("double")
    sd = F.sqrt(n * k / F.greatest(t, F.lit(1.0)) * (1 - k / F.greatest(t, F.lit(1.0))))
    first = F.greatest(low, F.floor(mode - 10 * sd - 10)).cast("long")
    last = F.least(high, F.ceil(mode + 10 * sd + 10)).cast("long")
    up = lambda x: (k - x) * (n - x) / ((x + 1) * (t - k - n + x + 1))
    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), F.lit(None).cast("long").alias("x"))
    zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"))
    steps = F.sequence(first, last)
    mass = F.aggregate(steps, zero, lambda a, x: F.struct((a["w"] * up(x.cast("double"))).alias("w"), (a["s"] + a["w"]).alias("s")))["s"]
    return let(
        mass * u,
        lambda goal: F.coalesce(
            F.aggregate(
                steps,
                start,
                lambda a, x: F.struct(
                    (a["w"] * up(x.cast("double"))).alias("w"),
                    (a["s"] + a["w"]).alias("s"),
                    F.coalesce(a["x"], F.when(a["s"] + a["w"] >= goal, x)).alias("x"),
                ),
            )["x"],
            last,
        ),
    )


def _split(counts: Column, drawn: Column, salt: Column) -> Column:
    """Counts of each source among ``drawn`` instances of a node: one draw a source, given those before."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    begin = F.struct(total.alias("t"), drawn.alias("n"), F.array().cast("array<long>").alias("out"))

    def draw(a: Column, x: Column) -> Column:
        u = (F.xxhash64(salt, F.size(a["out"])).bitwiseAND(F.lit((1 << 53) - 1)) + 0.5) / float(1 << 53)
        return let(
            _hypergeometric(u, a["t"], x, a["n"]),
            lambda got: F.struct((a["t"] - x).alias("t"), (a["n"] - got).alias("n"), F.concat(a["out"], F.array(got)).alias("out")),
        )

    return F.aggregate(counts, begin, draw)["out"]


def shard_counts(per: DataFrame, n_shards: int, n_units: int, seed: int = 17) -> DataFrame:
    """shard, ix, n: the leaves of the splitting tree, level by level."""
    ordered = F.array_sort(F.collect_list(F.struct("ix", "units")))
    nodes = per.agg(F.transform(ordered, lambda x: x["units"]).alias("counts"))
    nodes = nodes.select(F.lit(0).cast("long").alias("lo"), F.lit(n_shards).cast("long").alias("hi"), "counts")
    upto = lambda s: F.floor(F.lit(n_units) * s.cast("double") / n_shards).cast("long")
    width, level = n_shards, 0
    while width > 1:
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("long")
        left = _split(F.col("counts"), upto(mid) - upto(F.col("lo")), F.xxhash64(F.lit(seed), "lo", "hi"))
        both = let(
            left,
            lambda x: F.array(
                F.struct(F.col("lo").alias("lo"), mid.alias("hi"), x.alias("counts")),
                F.struct(mid.alias("lo"), F.col("hi").alias("hi"), F.zip_with("counts", x, lambda a, b: a - b).alias("counts")),
            ),
        )
        one = F.array(F.struct("lo", "hi", "counts"))
        nodes = nodes.select(F.inline(F.when(F.col("hi") - F.col("lo") > 1, both).otherwise(one)))
        width, level = (width + 1) // 2, level + 1
        if level % 6 == 0:
            nodes = keep(nodes.repartition("lo"), "mix-tree")
    return nodes.select(F.col("lo").alias("shard"), F.posexplode("counts").alias("ix", "n"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 17) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with sizes and offsets, sources with targets, spans of the mix).

    A span is words [first, first + n) of one document, as the ``pass_no``-th taking of a block,
    placed in ``shard`` at ``slot``. A shard is read in slot order.
    """
    rows = keep(sized(docs, text, source), "mix-sizes")
    per = keep(_plan(targets(rows), block), "mix-sources")
    n_units, words, n_rows = (per.agg(F.sum("units"), F.sum("quota")).first() or (0, 0)) + (rows.count(),)
    n_shards = max(1, -(-(words or 0) // shard_words))
    joined = rows.join(small_side(per), rows["source"].eqNullSafe(per["source"])).drop(per["source"])
    placed = running_offset(
        joined.select("doc_id", "source", "size", "d1", "d2", "ix", "source_size", "target"), "ix", "d1", ["d2", "size"], "size", n_rows, "at"
    )
    placed = keep(placed, "mix-stream")
    deal = placed.where("size > 0").join(
        small_side(per.select("ix", "blocks", "passes", "rest", "mul", "add", "short_at", "short_by", "units")), "ix"
    )
    block_no = F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)))
    deal = deal.withColumn("block", block_no).withColumn("pass_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
    pos = _permuted(F.col("block"))
    length = F.when(F.col("block") == F.col("blocks") - 1, F.lit(block) - F.col("short_by")).otherwise(F.lit(block))
    begun = F.col("pos") * block - F.when(F.col("pos") > F.col("short_at"), F.col("short_by")).otherwise(0)
    allowed = F.when(F.col("pass_no") < F.col("passes"), length).otherwise(F.greatest(F.least(F.col("rest") - begun, length), F.lit(0)))
    deal = deal.withColumn("pos", pos).withColumn("allowed", allowed)
    start = F.greatest(F.col("block") * block, F.col("at"))
    stop = F.least(F.col("block") * block + F.col("allowed"), F.col("at") + F.col("size"))
    deal = (
        deal.withColumn("first", start - F.col("at"))
        .withColumn("n", stop - start)
        .where("n > 0")
        .select("ix", (F.col("pass_no") * F.col("blocks") + F.col("pos")).alias("unit"), "doc_id", "source", "d2", "at", "pass_no", "first", "n")
    )
    leaves = shard_counts(per, n_shards, n_units or 0, seed)
    ends = F.sum("n").over(Window.partitionBy("ix").orderBy("shard"))
    dealt = leaves.withColumn("end", ends).where("n > 0")
    dealt = dealt.select("ix", "shard", F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)).alias("unit"))
    slot = F.xxhash64(F.lit(seed), "shard", "ix", "unit")
    # the leaves' size is unknown to the planner, and grows with the corpus: never to be broadcast
    spans = deal.join(dealt.hint("merge"), ["ix", "unit"]).withColumn("slot", slot)
    return placed, per, spans.select("shard", "slot", "source", "ix", "doc_id", "d2", "at", "pass_no", "first", "n")


def taken_words(placed: DataFrame, spans: DataFrame) -> DataFrame:
    """Every document with the words that the mix takes of it, repeats counted."""
    took = spans.groupBy("ix", "at").agg(F.sum("n").alias("taken"), F.countDistinct("shard").alias("n_shards"))
    took = took.withColumn("holds", F.lit(True))
    docs = placed.withColumn("holds", F.col("size") > 0)
    return docs.join(took, ["ix", "at", "holds"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix with its words: shard, slot, source, doc_id, pass_no, first_word, n_words, text.

    A document's words are split once; white space inside a span stays as it was. The rows of a shard
    come together, shuffled by slot.
    """
    _, _, spans = mix(docs, **options)
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    part = F.struct("shard", "slot", "source", "pass_no", F.col("first").alias("first_word"), F.col("n").alias("n_words"))
    per_doc = spans.groupBy(ident.alias("_id"), F.col("d2").alias("_d2")).agg(F.collect_list(part).alias("_parts"))
    bodies = docs.select("doc_id", "text", ident.alias("_id"), F.md5(F.coalesce("text", F.lit(""))).alias("_d2")).dropDuplicates(["_id", "_d2"])
    pieces = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    cut = let(
        pieces,
        lambda w: F.transform(
            "_parts", lambda p: p.withField("text", F.array_join(F.slice(w, (p["first_word"] + 1).cast("int"), p["n_words"].cast("int")), ""))
        ),
    )
    spread = bodies.join(per_doc.hint("merge"), ["_id", "_d2"]).select("doc_id", F.inline(cut))
    order = ["shard", "slot", "doc_id", "first_word", "pass_no"]
    return spread.repartition("shard").sortWithinPartitions(*order).select("shard", "slot", "doc_id", "source", "pass_no", "first_word", "n_words", "text")
