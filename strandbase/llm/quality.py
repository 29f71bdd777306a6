"""Operator 5, quality classifier: document evidence with hierarchical empirical-Bayes site posteriors.

Evidence: two logistic models (good quality; toxic) on figures of a text: shares of
kinds of bytes, repetition of words and of word runs, lengths, and the summed
log-odds of words that are significantly more (or less) frequent in documents with
a label.  They are fitted on at most ``most_labelled`` labelled documents, those
with the least hash of their id (of repeated ids one row counts), and for each label
with at most ``most_words`` words, those of the largest test statistic; these two
bounds of the fit are parameters and make what the driver holds bounded.

Sites: over all documents the expected labels are summed by host and by path
(host and path columns) in a grouped aggregation.  A host's rate is shrunk to the
global rate, a path's to its host's, the strength of the shrinkage being
estimated from the spread of the rates (method of moments for a beta prior), so
sparse sites stay near what is above them.  A document's posterior is its evidence
with the prior rate replaced by its path's.

A document is kept if P(good) >= 0.5 and P(toxic) < 0.5.

Null texts count as empty; null hosts or paths are sites of their own; labels
without a document and null labels are ignored, of repeated labels the largest
counts; with no labels of one kind that model says the share seen (none: good and
not toxic); every input row gives one row, repeated ids included; extra columns are
carried by ``classify``.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise
from .vectext import BYTE_VALUE_LOWER, count_sorted, mix, shingle_hashes, slices, span_hashes, string_parts, word_spans

U64 = np.uint64
MOST_LABELLED = 20_000
MOST_WORDS = 8_192
MOST_BROADCAST = 200_000

#: Bytes that end a word: ASCII other than letters and digits.
_ENDS_WORD = np.zeros(256, bool)
_ENDS_WORD[[b for b in range(128) if not chr(b).isalnum()]] = True
_KINDS = np.full(256, 6)
for _i, _which in enumerate((str.isupper, str.islower, str.isdigit, str.isspace)):
    _KINDS[[b for b in range(128) if _which(chr(b))]] = _i
_KINDS[[ord(c) for c in ".,;:?'\"()-"]] = 4
_KINDS[128:] = 5
N_FEATURES = 19


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct words of each text and of their beginnings, in order; their number before each text: n + 1).

    Beginnings of 4 and 5 bytes let what is learned of a word count for its inflections.
    """
    starts, ends, before = word_spans(data, offsets, _ENDS_WORD)
    values = BYTE_VALUE_LOWER[data]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    hashes, owners = [span_hashes(values, starts, ends)], [owner]
    for size in (4, 5):
        long = ends - starts > size
        hashes.append(mix(span_hashes(values, starts[long], starts[long] + size) + U64(size)))
        owners.append(owner[long])
    hashes, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[first], np.concatenate(([0], np.cumsum(np.bincount(owner[first], minlength=len(offsets) - 1))))


def _per_text(owner: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of distinct keys, largest number of one key) of each text."""
    if not len(keys):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (o[1:] != o[:-1]))))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, o[first], np.diff(np.append(first, len(k))))
    return np.bincount(o[first], minlength=n), most


def text_figures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(n, N_FEATURES - 4) figures of each text that need no model."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    shares = np.bincount(owner * 7 + _KINDS[data], minlength=7 * n).reshape(n, 7) / np.maximum(size, 1)[:, None]
    lines = np.bincount(owner[data == 10], minlength=n) + 1
    starts, ends, before = word_spans(data, offsets)
    words = np.diff(before)
    hashes = span_hashes(BYTE_VALUE_LOWER[data], starts, ends)
    distinct, most = _per_text(np.repeat(np.arange(n), words), hashes, n)
    runs, run_before = shingle_hashes(hashes, before, 3)
    number = np.diff(run_before)
    distinct_runs, most_runs = _per_text(np.repeat(np.arange(n), number), runs, n)
    w = np.maximum(words, 1)
    return np.column_stack(
        [
            shares, np.sqrt(shares[:, 6]), np.log1p(words), distinct / w * np.log1p(words) / 5, most / w, 1 - distinct_runs / np.maximum(number, 1),
            most_runs / np.maximum(number, 1), (size - words) / w / 10, np.log1p(words / lines),
        ]
    )


@dataclass
class Lexicon:
    """Word hashes in order, with the log-odds of each label."""

    keys: np.ndarray
    good: np.ndarray
    toxic: np.ndarray

    def figures(self, words: np.ndarray, before: np.ndarray) -> np.ndarray:
        """(n, 4): the sum of positive and of negative log-odds of a text's words, for either label, on a log scale."""
        n = len(before) - 1
        owner = np.repeat(np.arange(n), np.diff(before))
        at = np.searchsorted(self.keys, words)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == words if len(self.keys) else np.zeros(len(words), bool)
        out = [np.bincount(owner[hit], np.maximum(sign * column[at[hit]], 0), n) for column in (self.good, self.toxic) for sign in (1, -1)]
        return np.log1p(np.column_stack(out)) if len(self.keys) else np.zeros((n, 4))


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept
    rate: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1], -30, 30)


def fit_logistic(x: np.ndarray, y: np.ndarray, otherwise: float, ridge: float = 1.0, rounds: int = 40, tolerance: float = 1e-8) -> Logistic:
    """Ridge logistic regression by Newton steps; with one class only, a constant."""
    d = x.shape[1]
    rate = float((y.sum() + otherwise) / (len(y) + 1))
    if len(y) == 0 or y.min() == y.max():
        return Logistic(np.zeros(d), np.ones(d), np.append(np.zeros(d), np.log(rate / (1 - rate)) if 0 < rate < 1 else (30.0 if rate >= 1 else -30.0)), min(max(rate, 1e-6), 1 - 1e-6))
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(d + 1)
    penalty = np.append(np.full(d, ridge), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve((z * v[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < tolerance:
            break
    return Logistic(mean, scale, w, rate)


@dataclass
class Evidence:
    lexicon: Lexicon
    good: Logistic
    toxic: Logistic

    def logits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = string_parts(column)
        x = np.column_stack([text_figures(*parts), self.lexicon.figures(*distinct_words(*parts))])
        return self.good.logits(x), self.toxic.logits(x)


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, most_words: int = MOST_WORDS, id_column: str = "doc_id", text_column: str = "text") -> Evidence:
    """Fit the evidence on a bounded sample of labelled documents."""
    known = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.max("quality").alias("good"), F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(most_labelled)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(F.broadcast(sample), "id").dropDuplicates(["id"]).select("text", "good", "toxic")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                parts = string_parts(part.column("text"))
                x = text_figures(*parts)
                words, before = distinct_words(*parts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("good"), part.column("toxic"), pa.array(list(x)), pa.array([words[a:b].tobytes() for a, b in zip(before[:-1], before[1:], strict=True)], pa.binary())],
                    ["good", "toxic", "figures", "words"],
                )

    measured = materialise(rows.select("text", F.col("good").cast("int"), F.col("toxic").cast("int")).mapInArrow(measure, "good int, toxic int, figures array<double>, words binary"), "labelled")
    n = measured.agg(*(F.count(F.when(F.expr(c), 1)).cast("double") for c in ("good = 1", "good = 0", "toxic = 1", "toxic = 0"))).first()

    def by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.frombuffer(w, U64) for w in batch.column("words").to_pylist()]
            sizes = list(map(len, words))
            flags = []
            for name in ("good", "toxic"):
                y = np.array([-1 if v is None else v for v in batch.column(name).to_pylist()])
                flags += [np.repeat(y == 1, sizes), np.repeat(y == 0, sizes)]
            flat = np.concatenate(words) if words else np.zeros(0, U64)
            sums = [count_sorted(flat, f.astype(np.int64)) for f in flags]
            if len(flat):
                yield pa.RecordBatch.from_arrays([pa.array(sums[0][0].view(np.int64)), *(pa.array(s[2]) for s in sums)], ["word", "a", "b", "c", "d"])

    counts = measured.mapInArrow(by_word, "word long, a long, b long, c long, d long").groupBy("word").agg(*(F.sum(c).alias(c) for c in "abcd"))

    def odds(yes: str, no: str, n_yes: float, n_no: float):
        """(log-odds drawn to zero by twice their standard error, z of the difference of shares)."""
        p, q = F.col(yes) / F.lit(max(n_yes, 1.0)), F.col(no) / F.lit(max(n_no, 1.0))
        both = (F.col(yes) + F.col(no) + 1) / F.lit(n_yes + n_no + 2)
        z = (p - q) / F.sqrt(both * (1 - both) * F.lit(1 / max(n_yes, 1.0) + 1 / max(n_no, 1.0)))
        ratio = F.log((F.col(yes) + 0.5) / F.lit(n_yes + 1) / ((F.col(no) + 0.5) / F.lit(n_no + 1)))
        error = F.sqrt(1 / (F.col(yes) + 0.5) + 1 / (F.col(no) + 0.5))
        return F.signum(ratio) * F.greatest(F.abs(ratio) - 2 * error, F.lit(0.0)), z

    good, zg = odds("a", "b", n[0], n[1])
    toxic, zt = odds("c", "d", n[2], n[3])
    enough = (F.col("a") + F.col("b") >= 3) | (F.col("c") + F.col("d") >= 3)
    kept = counts.where(enough).select("word", F.when(F.abs(zg) > 4, good).otherwise(0.0).alias("good"), F.when(F.abs(zt) > 4, toxic).otherwise(0.0).alias("toxic"), F.abs(zg).alias("zg"), F.abs(zt).alias("zt"))
    # A list for each label, so that the words of a rare one aren't pushed out by those of the other.
    lists = [kept.where(f"{label} != 0").orderBy(F.desc(z), "word").limit(most_words) for label, z in (("good", "zg"), ("toxic", "zt"))]
    words = lists[0].union(lists[1]).distinct().collect()
    keys = np.array([w.word for w in words], np.int64).view(U64)
    order = np.argsort(keys)
    lexicon = Lexicon(keys[order], np.array([w.good for w in words])[order], np.array([w.toxic for w in words])[order])

    def with_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.frombuffer(w, U64) for w in batch.column("words").to_pylist()]
            before = np.concatenate(([0], np.cumsum(list(map(len, words))))).astype(np.int64)
            x = np.column_stack([np.array(batch.column("figures").to_pylist()), lexicon.figures(np.concatenate(words), before)])
            yield pa.RecordBatch.from_arrays([batch.column("good"), batch.column("toxic"), pa.array(list(x))], ["good", "toxic", "x"])

    points = measured.mapInArrow(with_words, "good int, toxic int, x array<double>").collect()  # at most most_labelled rows

    def model(name: str, otherwise: float) -> Logistic:
        mine = [p for p in points if p[name] is not None]
        x = np.array([p.x for p in mine]).reshape(len(mine), N_FEATURES)
        return fit_logistic(x, np.array([p[name] == 1 for p in mine], float), otherwise)

    return Evidence(lexicon, model("good", 1.0), model("toxic", 0.0))


def with_evidence(docs: DataFrame, evidence: Evidence, text_column: str = "text", carry: bool = True) -> DataFrame:
    """``docs`` (or, without ``carry``, all but the text) with the columns __good and __toxic: log-odds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_column):
                good, toxic = evidence.logits(part.column(text_column))
                out = part if carry else part.drop_columns([text_column])
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(good), pa.array(toxic)], [*out.schema.names, "__good", "__toxic"])

    kept = docs.schema.fields if carry else [f for f in docs.schema.fields if f.name != text_column]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["__good double", "__toxic double"])
    return docs.mapInArrow(run, schema)


def _sigmoid(x):
    return 1 / (1 + F.exp(-x))


def _strength(rates: DataFrame, rate: str, n: str, above: str) -> float:
    """The pseudo-count of the beta prior: method of moments over sites, weighted by their documents."""
    v = F.col(above) * (1 - F.col(above))
    r = rates.agg(F.sum(F.col(n)), F.sum(F.col(n) * (F.col(rate) - F.col(above)) ** 2), F.sum(v), F.sum(F.col(n) * v), F.count("*")).first()
    if not r[0] or not r[4]:
        return 1.0
    spread, noise, mean = r[1] / r[0], r[2] / r[0], r[3] / r[0]
    between = max(spread - noise, 1e-9)
    return float(min(max(mean / between - 1, 2.0), 1e6))


@dataclass
class Sites:
    """(host, path, host_good, path_good, host_toxic, path_toxic) and the global rates."""

    table: DataFrame
    good: float
    toxic: float


def site_posteriors(slim: DataFrame, evidence: Evidence) -> Sites:
    """Shrunken rates from rows (__host, __path, __good, __toxic) of all documents."""
    paths = slim.groupBy("__host", "__path").agg(F.count("*").cast("double").alias("n"), F.sum(_sigmoid(F.col("__good"))).alias("g"), F.sum(_sigmoid(F.col("__toxic"))).alias("t"))
    paths = materialise(paths, "paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("t").alias("t")).first()
    rate = {"g": (total.g + evidence.good.rate) / (total.n + 1) if total.n else evidence.good.rate, "t": (total.t + evidence.toxic.rate) / (total.n + 1) if total.n else evidence.toxic.rate}
    hosts = materialise(paths.groupBy("__host").agg(F.sum("n").alias("hn"), F.sum("g").alias("hg"), F.sum("t").alias("ht")), "hosts")
    for k in "gt":
        strength = _strength(hosts.select((F.col(f"h{k}") / F.col("hn")).alias("r"), "hn", F.lit(rate[k]).alias("above")), "r", "hn", "above")
        hosts = hosts.withColumn(f"host_{k}", (F.col(f"h{k}") + strength * rate[k]) / (F.col("hn") + strength))
    joined = materialise(paths.join(hosts.select(F.col("__host").alias("h"), "host_g", "host_t"), F.col("__host") == F.col("h")).drop("h"), "site-rates")
    for k in "gt":
        strength = _strength(joined.select((F.col(k) / F.col("n")).alias("r"), "n", F.col(f"host_{k}").alias("above")), "r", "n", "above")
        joined = joined.withColumn(f"path_{k}", (F.col(k) + strength * F.col(f"host_{k}")) / (F.col("n") + strength))
    table = joined.select("__host", "__path", *(F.col(f"{level}_{k}").alias(f"{level}_{name}") for k, name in (("g", "good"), ("t", "toxic")) for level in ("host", "path")))
    return Sites(materialise(table, "sites"), rate["g"], rate["t"])


def _logit(x):
    return F.log(x / (1 - x))


def _judged(docs: DataFrame, labels: DataFrame, most_labelled: int, host_column: str, path_column: str, id_column: str, text_column: str, carry: bool) -> DataFrame:
    """``docs`` (without ``carry``, only the id) with the columns __p_good, __p_toxic, __keep and the site rates."""
    evidence = fit(docs, labels, most_labelled, id_column=id_column, text_column=text_column)
    site = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    keyed = docs.select(F.col(id_column), F.col(text_column).alias("__text"), site(host_column).alias("__host"), site(path_column).alias("__path"))
    slim = materialise(with_evidence(keyed, evidence, "__text", carry=False), "evidence")
    sites = site_posteriors(slim, evidence)
    rows = with_evidence(docs.withColumns({"__host": site(host_column), "__path": site(path_column)}), evidence, text_column) if carry else slim
    few = sites.table.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    rates = sites.table.select("__host", "__path", *(F.col(c).alias(f"__{c}") for c in SITE_RATES))
    joined = rows.join(F.broadcast(rates) if few else rates, ["__host", "__path"])
    limit = lambda c: F.least(F.greatest(F.col(c), F.lit(1e-6)), F.lit(1 - 1e-6))
    bound = lambda p: min(max(p, 1e-6), 1 - 1e-6)
    p_good = _sigmoid(F.col("__good") + _logit(limit("__path_good")) - _logit(F.lit(bound(sites.good))))
    p_toxic = _sigmoid(F.col("__toxic") + _logit(limit("__path_toxic")) - _logit(F.lit(bound(sites.toxic))))
    out = joined.withColumns({"__p_good": p_good, "__p_toxic": p_toxic})
    return out.withColumn("__keep", (F.col("__p_good") >= 0.5) & (F.col("__p_toxic") < 0.5))


SITE_RATES = ("host_good", "path_good", "host_toxic", "path_toxic")


def classify(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, host_column: str = "source", path_column: str = "lang", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, p_good, p_toxic, host_good, path_good, host_toxic, path_toxic, keep) for each row."""
    out = _judged(docs, labels, most_labelled, host_column, path_column, id_column, text_column, carry=False)
    return out.select(id_column, *(F.col(f"__{c}").alias(c) for c in ("p_good", "p_toxic", *SITE_RATES, "keep")))


def keep_good(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, host_column: str = "source", path_column: str = "lang", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps."""
    out = _judged(docs, labels, most_labelled, host_column, path_column, id_column, text_column, carry=True)
    return out.where("__keep").select(*docs.columns)
