"""Language identification: script ranges narrow the candidates, Viterbi labels the words.

A word's score for a language is the log likelihood of its character 1- to 3-grams under that
language. The script of its first letter narrows the languages to those seen in that script in the
training rows. Viterbi over a document's words, with a penalty for each switch, labels spans of mixed
text; the prediction is the language with the most letters, the score its share of all letters.

Training: n-gram counts, made in tasks, from about ``SAMPLE_DOCS`` labelled documents with letters, chosen
by digest. All languages get the same share of the sample; what a smaller one leaves goes to the others, and each
keeps at least one document. Null labels are not learned from.

Defined results: a text that is null or without letters is ``und`` with score 0; without training rows
everything is ``und``; ties go to the language first in code-point order; repeated rows get the same
result; texts may be of any length; an empty table gives an empty result; further columns pass, one
named like the added column as ``<name>_input``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.binding import aside

#: Languages that are learned at most: the ones with most rows.
MOST_LANGS = 128
SAMPLE_DOCS = 6_000
BUCKETS = 1 << 17
SWITCH = 12.0
CACHED_WORDS = 200_000
#: Letters, and number signs such as superscripts and fractions, which are taken out again.
WORD = re.compile(r"[^\W\d_]+")
LETTERS = re.compile(r"\S+")
#: First code points of script ranges; those not named are "other". Fixed values of the Unicode standard.
SCRIPTS = (
    (0x0041, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"),
    (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"),
)
STARTS = np.array([a for a, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
SCRIPT_OF = np.array([NAMES.index(n) for _, n in SCRIPTS])


def _blanked(word: str) -> str:
    return "".join(c if c.isalpha() else " " for c in word)


def words_in(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    found = WORD.findall(text or "")
    if not all(map(str.isalpha, found)):
        found = [x for w in found for x in _blanked(w).split()]
    return "\n".join(found).lower().split("\n") if found else []


def word_spans(text: str | None) -> list[tuple[int, int]]:
    """Where the words stand in the text."""
    return [(m.start() + x.start(), m.start() + x.end()) for m in WORD.finditer(text or "") for x in LETTERS.finditer(_blanked(m[0]))]


def script_ids(words: list[str]) -> np.ndarray:
    first = np.array([ord(w[0]) for w in words])
    return SCRIPT_OF[np.maximum(np.searchsorted(STARTS, first, side="right") - 1, 0)]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- to 3-grams of all words, and where each word's grams begin."""
    raw = np.frombuffer(("\x02" + "\x02".join(words) + "\x02").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    a, b, c = raw[:-2], raw[1:-1], raw[2:]
    two, three = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    mix = lambda x: ((x * two) >> np.uint64(40)) % np.uint64(BUCKETS)
    one = mix(b + np.uint64(1 << 33))
    pair = mix((a * three) ^ (b + np.uint64(1 << 34)))
    triple = mix((a * three + b) * three ^ (c + np.uint64(1 << 35)))
    inside = b != 2
    ids = np.stack([one[inside], pair[inside], triple[inside]], axis=1)
    lengths = np.array([len(w) for w in words])
    return ids, np.concatenate([[0], np.cumsum(lengths)[:-1]])


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # bucket, language: log likelihood
    scripts: np.ndarray  # script, language: seen in training
    cache: dict[str, int] = field(default_factory=dict)
    scores: list[np.ndarray] = field(default_factory=list)

    def word_scores(self, words: list[str]) -> np.ndarray:
        ids, begins = grams(words)
        sums = np.add.reduceat(self.table[ids].sum(axis=1), begins, axis=0)
        may = self.scripts[script_ids(words)]
        may = np.where(may.any(axis=1, keepdims=True), may, True)
        return np.where(may, sums, sums.min() - 1e3).astype(np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        """Scores of words in order; each different word is scored once while it is cached."""
        cache = self.cache
        if len(cache) > CACHED_WORDS:
            cache.clear()
            self.scores = []
        fresh = list({w for w in words if w not in cache})
        if fresh:
            base = sum(len(x) for x in self.scores)
            self.scores.append(self.word_scores(fresh))
            cache.update(zip(fresh, range(base, base + len(fresh)), strict=True))
        if len(self.scores) > 1:
            self.scores = [np.concatenate(self.scores)]
        return self.scores[0][np.fromiter((cache[w] for w in words), dtype=np.int64, count=len(words))]


def counted(texts: Iterator[str]) -> np.ndarray:
    """Counts of the n-gram buckets, then of the letters by script."""
    counts = np.zeros(BUCKETS + len(NAMES), dtype=np.int64)
    for text in texts:
        words = words_in(text)
        if words:
            counts[:BUCKETS] += np.bincount(grams(words)[0].ravel(), minlength=BUCKETS)
            counts[BUCKETS:] += np.bincount(script_ids(words), weights=[len(w) for w in words], minlength=len(NAMES)).astype(np.int64)
    return counts


def fit(langs: list[str], seen: np.ndarray) -> Model | None:
    """Model of ``langs`` (sorted) from their counts (bucket or script, language)."""
    if not langs:
        return None
    counts, letters = seen[:BUCKETS] + 0.05, seen[BUCKETS:].astype(float)
    table = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    return Model(langs, table, letters > 1e-3 * np.maximum(letters.sum(axis=0), 1))


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Labels of all words of a batch of documents (scores of document after document), documents side by side."""
    n_words = int(lengths.sum())
    labels = np.zeros(n_words, dtype=np.int32)
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    if not len(order):
        return labels
    sizes = lengths[order]
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # documents with more than t words
    v = scores[begins[order]].astype(np.float64)
    ends = np.empty_like(v)
    steps = []
    for t in range(1, int(sizes[0])):
        k = active[t]
        ends[k : len(v)] = v[k:]
        v = v[:k]
        best = v.argmax(axis=1)
        jump = v[np.arange(k), best] - penalty
        switch = v < jump[:, None]
        steps.append((best.astype(np.int16), switch))
        v = np.maximum(v, jump[:, None]) + scores[begins[order[:k]] + t]
    ends[: len(v)] = v
    state = ends.argmax(axis=1)
    for t in range(int(sizes[0]) - 1, 0, -1):
        k = active[t]
        labels[begins[order[:k]] + t] = state[:k]
        best, switch = steps[t - 1]
        state[:k] = np.where(switch[np.arange(k), state[:k]], best, state[:k])
    labels[begins[order]] = state
    return labels


def label_texts(texts: list[str | None], model: Model | None, spans: bool = False) -> pd.DataFrame:
    """lang, score and, if asked for, spans (lang, start, stop in code points) of each text."""
    found = [words_in(t) for t in texts]
    lengths = np.array([len(w) for w in found], dtype=np.int64)
    words = [w for ws in found for w in ws]
    lang, score, runs = ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
    if model and words:
        labels = viterbi(model.rows(words), lengths)
        owner = np.repeat(np.arange(len(texts)), lengths)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        n = len(model.langs)
        share = np.bincount(owner * n + labels, weights=size, minlength=len(texts) * n).reshape(-1, n)
        top = share.argmax(axis=1)
        for i in np.flatnonzero(lengths):
            lang[i] = model.langs[top[i]]
        score = share.max(axis=1) / np.maximum(share.sum(axis=1), 1)
        if spans:
            begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            for i in np.flatnonzero(lengths):
                own = labels[begins[i] : begins[i] + lengths[i]]
                cut = np.flatnonzero(np.diff(own)) + 1
                at = word_spans(texts[i])
                for a, b in zip([0, *cut], [*cut, len(own)], strict=True):
                    runs[i].append({"lang": model.langs[own[a]], "start": at[a][0], "stop": at[b - 1][1]})
    return pd.DataFrame({"lang": lang, "score": score, "spans": runs}) if spans else pd.DataFrame({"lang": lang, "score": score})


def fair_share(sizes: list[int], total: int) -> int:
    """The greatest k for which the sum of min(size, k) is at most ``total``; 1 at least."""
    k, left = 0, total
    for i, size in enumerate(sorted(sizes)):
        k = left // (len(sizes) - i)
        if size > k:
            return max(k, 1)
        left -= size
    return max(k, *sizes, 1)


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """Fit on the sampled rows of ``docs``; the caller has left out what must not be learned from."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    # by the text alone: copies of one are sampled together, then counted as one row with its number
    digest = F.xxhash64(text).bitwiseAND(F.lit((1 << 30) - 1))
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), digest.alias("digest"))
    sizes = rows.groupBy("lang", "digest").agg(F.count("*").alias("copies")).groupBy("lang").agg(F.sum("copies").alias("rows"), F.count("*").alias("n"), F.min("digest").alias("least"))
    sizes = sizes.orderBy(F.desc("rows"), "lang").limit(MOST_LANGS).collect()
    langs = sorted(r["lang"] for r in sizes)
    seen = np.zeros((BUCKETS + len(NAMES), len(langs)), dtype=np.int64)
    if not langs:
        return None
    k = fair_share([r["n"] for r in sizes], SAMPLE_DOCS)
    upto = {r["lang"]: max(r["least"], int(min(1.0, k / r["n"]) * (1 << 30)) - 1) for r in sizes}
    bound = F.create_map(*[F.lit(x) for pair in upto.items() for x in pair])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {}
        for pdf in batches:
            for (name, copies), own in pdf.groupby(["lang", "copies"])["text"]:
                sums[name] = sums.get(name, 0) + copies * counted(own)
        for name, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": name, "bucket": at, "n": counts[at]})

    sample = rows.where(F.col("digest") <= bound[F.col("lang")]).groupBy("lang", "text").agg(F.count("*").alias("copies"))
    sums = sample.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    column = {name: i for i, name in enumerate(langs)}
    at = np.fromiter((column[x] for x in sums["lang"].to_pylist()), dtype=np.int64, count=sums.num_rows)
    seen[sums["bucket"].to_numpy(), at] = sums["n"].to_numpy()
    return fit(langs, seen)


def identify(docs: DataFrame, model: Model | None, text: str = "text", out: str = "language", spans: bool = False) -> DataFrame:
    """``docs`` with ``out``: struct of lang, score and, if asked for, spans."""
    kind = "struct<lang:string,score:double" + (",spans:array<struct<lang:string,start:int,stop:int>>>" if spans else ">")
    # buckets and languages bound its size; plain arrays, as executors need no copy of this package
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.table, model.scripts) if model else None)

    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Model(*sent.value) if sent.value else None
        for s in batches:
            parts = [label_texts(list(s.iloc[i : i + 1000]), model, spans) for i in range(0, len(s), 1000)]
            yield pd.concat(parts, ignore_index=True) if parts else label_texts([], model, spans)

    labelled.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return aside(docs, out).withColumn(out, F.pandas_udf(labelled, kind)(F.col(text)))


def held_out(doc_id: Column) -> Column:
    """Rows kept for testing: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
