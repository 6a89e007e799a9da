"""Personal data: pattern spans plus information-theoretic sanitisation of revealing terms (native).

Base spans (email, ip, card, phone) are the protected entities. The corpus then tells which words
give an entity away although it is masked: with N documents, an entity e in n(e) of them and a term t
in n(t), of which n(e, t) have t within ``CONTEXT`` code points of e,

    IC(e) = log2(N / n(e)),  PMI(e, t) = log2(N n(e, t) / (n(e) n(t))).

A term reveals as much of e as PMI(e, t) / IC(e). From ``GENERALISE`` on it is generalised to
``[TERM]``, from ``REMOVE`` on it is removed, in every document that holds e. A pair counts from
``SUPPORT`` different contexts on, so copies of one document are no evidence. n(t) is counted over
all documents, for the terms that have such a pair.

Defined results: a null text is empty and has no spans; repeated rows get the same spans; term
spans never overlap base spans; texts may be of any length; an empty table gives an empty result;
further columns pass, one named like the added column as ``<name>_input``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.binding import aside, let, spare
from loam.plans.materialize import keep, small_side

CONTEXT = 120
SUPPORT = 3
GENERALISE = 0.85
REMOVE = 1.0
KINDS = ("email", "ip", "card", "phone")
NOT_LETTER = r"[^\p{L}]+"

#: The contract's patterns with possessive loops; a run is entered at its start or where the last match ended.
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _ip_ok(m: Column) -> Column:
    bare = lambda x: F.regexp_replace(x, "^0+", "")
    return F.forall(F.split(m, r"\."), lambda x: (F.length(bare(x)) <= 3) & (F.coalesce(bare(x).try_cast("int"), F.lit(0)) <= 255))


VALID = {
    "email": lambda m: F.lit(True),
    "ip": _ip_ok,
    "card": lambda m: F.length(_digits(m)).between(16, 19) & F.call_function("luhn_check", _digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}
#: Cheap tests without which a pattern can't match.
MAY = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.contains(t, F.lit(".")) & t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
SPAN = "array<struct<kind:string,start:int,stop:int,value:string>>"


def located(text: Column, pattern: Column, kind: str) -> Column:
    """All matches of a pattern as spans in code points: the pieces between them give the offsets."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["0"])
        end = begin + F.length(x["1"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("stop"), x["1"].alias("value"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

    found = F.filter(F.arrays_zip(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))), lambda x: x["1"].isNotNull())
    return F.aggregate(found, start, step)["out"]


def base_spans(text: Column) -> Column:
    """Valid spans of every kind, by kind as listed, then start."""
    none = F.array().cast(SPAN)
    each = []
    for kind in KINDS:
        valid = VALID[kind]
        spans = F.filter(located(text, F.lit(PATTERNS[kind]), kind), lambda s: valid(s["value"]))
        each.append(F.when(MAY[kind](text), spans).otherwise(none))
    return F.concat(*each)


def _entity(span: Column) -> Column:
    value = F.when(span["kind"] == "email", F.lower(span["value"])).when(span["kind"] == "ip", span["value"]).otherwise(_digits(span["value"]))
    return F.concat(span["kind"], F.lit(":"), value)


def _context_terms(text: Column, span: Column) -> Column:
    """Lower-case letter runs within CONTEXT code points of a span, those cut by the window's ends left out."""
    begin = F.greatest(span["start"] - CONTEXT, F.lit(0))
    left = F.substring(text, begin + 1, span["start"] - begin)
    right = F.substring(text, span["stop"] + 1, F.lit(CONTEXT))
    left = F.when(begin > 0, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left)
    right = F.when(F.length(right) == CONTEXT, F.regexp_replace(right, r"\p{L}+$", "")).otherwise(right)
    runs = F.split(F.lower(F.concat_ws(" ", left, right)), NOT_LETTER)
    return F.array_distinct(F.filter(runs, lambda w: F.length(w) >= 3))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n_t: how many documents hold each of the terms (distinct).

    Counted before the join: tasks combine their own counts, and the join makes a row a term. It is an inner
    join, because the optimizer would move a semi join below the count, where it meets every word.
    """
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), NOT_LETTER))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n_t")).join(terms, "term")


def revealing_terms(docs: DataFrame, held: DataFrame) -> DataFrame:
    """entity, term, share (of the entity's information), from all documents.

    ``held``: the kept rows that have base spans (doc_id, th, text, spans).
    """
    seen = held.select("doc_id", "th", "text", F.explode("spans").alias("s"))
    seen = seen.select("doc_id", "th", _entity(F.col("s")).alias("entity"), _context_terms(F.col("text"), F.col("s")).alias("terms"))
    n_e = seen.groupBy("entity").agg(F.countDistinct("doc_id", "th").alias("n_e"))
    pairs = seen.withColumn("ctx", F.xxhash64("terms")).select("entity", "doc_id", "th", "ctx", F.explode("terms").alias("term"))
    pairs = pairs.groupBy("entity", "term").agg(F.countDistinct("doc_id", "th").alias("n_et"), F.countDistinct("ctx").alias("contexts"))
    pairs = keep(pairs.where(F.col("contexts") >= SUPPORT), "pii-pairs")
    terms = small_side(keep(pairs.select("term").distinct(), "pii-terms"))
    n_t = term_counts(docs, terms)
    n = docs.agg(F.count("*").alias("n"))
    scored = pairs.join(n_t, "term").join(n_e, "entity").crossJoin(F.broadcast(n))  # n is a single row
    ic = F.log2(F.col("n") / F.col("n_e"))
    pmi = F.log2(F.col("n").cast("double") * F.col("n_et") / (F.col("n_e").cast("double") * F.col("n_t")))
    return scored.withColumn("share", pmi / ic).where((F.col("share") >= GENERALISE) & (ic > 0)).select("entity", "term", "share")


def _doc_key(df: DataFrame, ident: str = "_id", th: str = "_th") -> DataFrame:
    return df.withColumn(ident, F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).withColumn(th, F.xxhash64(F.coalesce("text", F.lit(""))))


def find_pii(docs: DataFrame, out: str = "pii") -> DataFrame:
    """``docs`` with ``out``: struct of base (spans) and terms (spans with their share)."""
    docs = aside(docs, out)
    ident, th, kept = (spare(docs, c) for c in ("_id", "_th", "_terms"))
    body = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select("doc_id", "text")
    held = keep(
        _doc_key(plain).select(F.col("_id").alias("doc_id"), F.col("_th").alias("th"), body.alias("text"), base_spans(body).alias("spans")).where(F.size("spans") > 0).dropDuplicates(["doc_id", "th"]),
        "pii-held",
    )
    risky = small_side(keep(revealing_terms(plain, held), "pii-risky"))
    owners = held.select("doc_id", "th", F.explode(F.array_distinct(F.transform("spans", _entity))).alias("entity"))
    wanted = owners.join(risky, "entity").groupBy("doc_id", "th", "term").agg(F.max("share").alias("share"))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})"), F.col("term"), F.lit(r"(?!\p{L})"))
    shared = F.transform(located(F.col("text"), pattern, "term"), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.col("share").alias("share")))
    apart = lambda s: ~F.exists("spans", lambda b: (s["start"] < b["stop"]) & (b["start"] < s["stop"]))
    placed = held.join(wanted, ["doc_id", "th"]).select("doc_id", "th", F.explode(F.filter(shared, apart)).alias("t"))
    terms = placed.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list("t")).alias("terms"))
    terms = small_side(keep(terms.select(F.col("doc_id").alias(ident), F.col("th").alias(th), F.col("terms").alias(kept)), "pii-placed"), 20_000)
    named = _doc_key(docs, ident, th).join(terms, [ident, th], "left")
    empty = F.array().cast("array<struct<start:int,stop:int,share:double>>")
    found = F.struct(base_spans(body).alias("base"), F.coalesce(kept, empty).alias("terms"))
    return named.withColumn(out, found).drop(ident, th, kept)


def _chain(spans: Column, text: Column) -> Column:
    """The text with each span's label in its place; of spans that overlap the first by start (then longest) is
    replaced whole, the others from where it ends."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("end"), s["label"].alias("label"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        between = F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        put = F.concat(a["out"], between, s["label"])
        return F.when(-s["end"] <= a["at"], a).otherwise(F.struct((-s["end"]).alias("at"), put.alias("out")))

    return let(F.aggregate(ordered, begin, step), lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced; rows without spans are unchanged."""
    out = spare(docs, "_pii")
    found = find_pii(docs, out)
    pii = F.col(out)
    label = lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("label"))
    term = lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.when(s["share"] >= REMOVE, F.lit("")).otherwise(F.lit("[TERM]")).alias("label"))
    spans = F.concat(F.transform(pii["base"], label), F.transform(pii["terms"], term))
    text = F.when(F.size(pii["base"]) + F.size(pii["terms"]) > 0, _chain(spans, F.col("text"))).otherwise(F.col("text"))
    return found.withColumn("text", text).drop(out)
