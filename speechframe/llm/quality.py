"""Quality classifier with hierarchical empirical Bayes.

A document's own evidence is a classifier's probability that it is good: of high quality and not
toxic. A host's and a path's rates of good documents, labels where there are any and the classifier's
probabilities elsewhere, are beta-binomial posteriors: a path shrinks towards its host, a host towards
the global rate, the more the fewer documents it has. Prior strengths come from the spread of the
rates themselves. A document's score is the path's posterior odds times its own evidence.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechframe.llm.common import row_key, small_batches, without_rows, written
from speechframe.llm.shingles import text_chunks, words_of

#: Labelled documents that the classifier is fitted on, at most; those with the least hash of their doc_id.
SAMPLE_ROWS = 20_000
#: The sampled documents that must hold a word of a lexicon, and what its log-odds must exceed by two standard errors. The
#: sample bounds the lexicon: no other limit is set.
LEXICON_DOCS, LEXICON_ODDS = 8, 0.7
#: Log-odds from which a word counts as strong.
STRONG = 2.5
#: Rows of the path table up to which it is broadcast (some 60 bytes a row); beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000
TARGETS = ("low", "toxic")

_UPPER, _DIGIT, _LINE, _SPACE, _BANG, _PIPE, _SIGN = range(7)


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, -1, dtype=np.int8)
    kinds[0x41:0x5B], kinds[0x30:0x3A], kinds[0x0A], kinds[0x20], kinds[0x21], kinds[0x7C] = _UPPER, _DIGIT, _LINE, _SPACE, _BANG, _PIPE
    kinds[list(b"#$%&*@^~<>{}[]\\_=+/")] = _SIGN
    return kinds


BYTE_KIND = _byte_kinds()


@dataclass
class Model:
    """Word log-odds and logistic weights for each target; without training data it says the prior."""

    words: dict[str, np.ndarray] = field(default_factory=dict)
    odds: dict[str, np.ndarray] = field(default_factory=dict)
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    prior: dict[str, float] = field(default_factory=lambda: dict.fromkeys(TARGETS, 0.0))

    def features(self, texts: list[bytes]) -> np.ndarray:
        """A row for each text: shape of its bytes and words, and what its words say for each target."""
        n = len(texts)
        hashes, starts, ends, bounds = words_of(texts)
        counts = np.diff(bounds)
        out = np.zeros((n, 15 + 3 * len(TARGETS)))
        sizes = np.array([len(t) for t in texts])
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        owner = np.repeat(np.arange(n), sizes)
        kinds = BYTE_KIND[data].astype(np.int64)
        held = kinds >= 0
        table = np.bincount(owner[held] * 7 + kinds[held], minlength=7 * n).reshape(n, 7)
        out[:, :7] = table / np.maximum(sizes, 1)[:, None]
        word_of = np.repeat(np.arange(n), counts)
        per = np.maximum(counts, 1)
        out[:, 7] = np.bincount(word_of, ends - starts, minlength=n) / per
        order = np.lexsort((hashes, word_of))
        w, h = word_of[order], hashes[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (w[1:] != w[:-1]) | (h[1:] != h[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(h)))
        out[:, 8] = np.bincount(w[at], minlength=n) / np.sqrt(per)
        out[:, 9] = np.bincount(w[at], minlength=n) / per
        most = np.zeros(n)
        np.maximum.at(most, w[at], times)
        out[:, 10] = most / per
        same = (hashes[1:] == hashes[:-1]) & (word_of[1:] == word_of[:-1])
        out[:, 11] = np.bincount(word_of[1:][same], minlength=n) / per
        out[:, 12] = np.log1p(counts)
        out[:, 13] = (counts == 0).astype(float)
        out[:, 14] = (table[:, _UPPER] > 0.3 * sizes).astype(float)
        for k, target in enumerate(TARGETS):
            words, odds = self.words.get(target), self.odds.get(target)
            if words is None or not len(words):
                continue
            place = np.minimum(np.searchsorted(words, h[at]), len(words) - 1)
            weight = np.where(words[place] == h[at], odds[place], 0.0)
            for shift, sign in ((0, 1), (1, -1)):
                best = np.zeros(n)
                np.maximum.at(best, w[at], sign * weight)
                out[:, 15 + 3 * k + shift] = best
            out[:, 15 + 3 * k + 2] = np.log1p(np.bincount(w[at], weight >= STRONG, minlength=n))
        return out

    def logits(self, features: np.ndarray) -> dict[str, np.ndarray]:
        out = {}
        for target in TARGETS:
            if target in self.weights:
                x = np.clip((features - self.mean) / self.scale, -8, 8)
                out[target] = x @ self.weights[target][1:] + self.weights[target][0]
            else:
                out[target] = np.full(len(features), self.prior[target])
        return out

    def good(self, features: np.ndarray) -> np.ndarray:
        """Probability of neither target, kept away from 0 and 1."""
        logits = self.logits(features)
        p = np.prod([1 / (1 + np.exp(np.clip(logits[t], -30, 30))) for t in TARGETS], axis=0)
        return np.clip(p, 1e-6, 1 - 1e-6)


def _fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method with a ridge on all weights but the first."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id, low, toxic (0 or 1, worst of repeated labels) where both are known."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    return known.groupBy("doc_id").agg(F.max(F.when(F.col("quality") > 0, 0).otherwise(1)).alias("low"), F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The classifier, fitted on at most sample_rows labelled documents: word lexicons on one half, weights on the other."""
    order = F.xxhash64("doc_id")
    sample = labelled(labels).orderBy(order, "doc_id").limit(sample_rows)
    # of rows that share a sampled doc_id one, whichever text has the least hash
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    kept = found.groupBy("doc_id").agg(F.min_by("text", row_key()).alias("text"), *[F.first(t).alias(t) for t in TARGETS])
    rows = written(kept.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2))), "labelled")

    def word_counts(batches):
        for batch in batches:
            low, toxic = (batch.column(batch.schema.get_field_index(t)).to_numpy(zero_copy_only=False) for t in TARGETS)
            for first, texts in text_chunks(batch.column(1)):
                hashes, _, _, bounds = words_of(texts)
                owner = np.repeat(np.arange(first, first + len(texts)), np.diff(bounds))
                pairs = np.unique(np.rec.fromarrays([hashes, owner], names="h,o"))
                words, place, n = np.unique(pairs["h"], return_inverse=True, return_counts=True)
                columns = [n, *(np.bincount(place, t[pairs["o"]], minlength=len(words)).astype(np.int64) for t in (low, toxic))]
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), *(pa.array(c, pa.int64()) for c in columns)], names=["word", "n", *TARGETS])

    model = Model()
    half = rows.where("half = 0")
    total = half.agg(F.count("*").alias("n"), *[F.sum(t).alias(t) for t in TARGETS]).first()
    counted = half.mapInArrow(word_counts, "word long, n long, low long, toxic long").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", *TARGETS)]).where(F.col("n") >= LEXICON_DOCS)
    for target in TARGETS:
        if not total[target] or total[target] == total["n"]:
            continue
        hit, miss = F.col(target) + 0.5, F.col("n") - F.col(target) + 0.5
        odds = F.log(hit / miss) - float(np.log(total[target] / (total["n"] - total[target])))
        sure = F.abs(odds) - 2 * F.sqrt(1 / hit + 1 / miss)
        picked = counted.select("word", odds.alias("odds"), sure.alias("sure")).where(F.col("sure") > LEXICON_ODDS).collect()
        words = np.array([r["word"] for r in picked], dtype=np.int64).view(np.uint64)
        by = np.argsort(words)
        model.words[target], model.odds[target] = words[by], np.array([r["odds"] for r in picked])[by]

    def features(batches):
        for batch in batches:
            for first, texts in text_chunks(batch.column(1)):
                part = batch.slice(first, len(texts))
                rows = model.features(texts)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(t)) for t in TARGETS), pa.array(list(rows), pa.list_(pa.float64()))], names=[*TARGETS, "x"])

    seen = rows.where("half = 1").mapInArrow(features, "low int, toxic int, x array<double>").collect()  # at most sample_rows rows of 21 numbers
    if len(seen) >= 20:
        x = np.array([r["x"] for r in seen])
        model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        x = np.clip((x - model.mean) / model.scale, -8, 8)
        for target in TARGETS:
            y = np.array([r[target] for r in seen], dtype=float)
            model.prior[target] = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
            if 0 < y.sum() < len(y):
                model.weights[target] = _fitted(x, y)
    return model


def _strength(rates: DataFrame, parent: Column) -> Column:
    """Prior strength by moments, from rows of (n, s) and their parent's rate: what spread the rates have beyond chance."""
    rate = F.col("s") / F.col("n")
    noise = F.sum(F.col("n") * (rate - parent) ** 2) / F.sum("n") - F.sum(parent * (1 - parent)) / F.sum("n")
    chance = F.sum(F.col("n") * parent * (1 - parent)) / F.sum("n")
    return F.least(F.lit(1e4), F.greatest(F.lit(2.0), F.coalesce(F.try_divide(chance, F.greatest(noise, F.lit(1e-9))), F.lit(1e4))))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """The first segment of a URL's path."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]*)", 1)


def quality_scores(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS, fitted_on: DataFrame | None = None) -> DataFrame:
    """Per document row: doc_id, row, host, path, evidence (the classifier's probability of a good document), host_rate
    and path_rate (posterior means, without the document itself), score (posterior probability) and keep.

    By default the host is the column source and the path the column lang; with URLs, pass url_host()
    and url_path(). The classifier is fitted on docs, or on fitted_on, another table that the labels are of; then docs
    themselves have none. Null hosts and paths form groups of their own. Null texts count as empty and are
    scored as such; repeated rows are each scored; without labels all evidence is even and every row is
    kept; an empty table stays empty; other columns are ignored; whole texts count, very long ones in linear time. Rates
    cover all rows; groups of any size are summed before the shuffle.
    """
    small_batches(docs.sparkSession)
    model = fit(docs if fitted_on is None else fitted_on, labels, sample_rows)
    keyed = docs.select(
        "doc_id", "text", row_key().alias("row"), F.coalesce((host if host is not None else F.col("source")).cast("string"), F.lit("")).alias("host"), F.coalesce((path if path is not None else F.col("lang")).cast("string"), F.lit("")).alias("path")
    )

    def evidence(batches):
        for batch in batches:
            for first, texts in text_chunks(batch.column(1)):
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (0, 2, 3, 4)), pa.array(model.good(model.features(texts)))], names=["doc_id", "row", "host", "path", "evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = keyed.mapInArrow(evidence, f"doc_id {kind}, row long, host string, path string, evidence double")
    truth = labelled(labels if fitted_on is None else labels.limit(0)).select("doc_id", ((F.col("low") == 0) & (F.col("toxic") == 0)).cast("double").alias("label"))
    rows = written(scored.join(truth, "doc_id", "left").withColumn("y", F.coalesce("label", "evidence")), "evidence")

    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    paths = written(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = float(np.clip((whole["s"] or 0.0) / (whole["n"] or 1), 1e-4, 1 - 1e-4))
    m_host = hosts.agg(_strength(hosts, F.lit(rate)).alias("m")).first()["m"]
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"), ((F.col("s") + m_host * rate) / (F.col("n") + m_host)).alias("r"))
    nested = paths.join(hosts, "host")
    m_path = nested.agg(_strength(nested, F.col("r")).alias("m")).first()["m"]
    sites = nested.select("host", "path", "n", "s", "host_n", "host_s")
    if paths.count() <= BROADCAST_ROWS:
        sites = F.broadcast(sites)
    # without the document itself, so that its evidence counts once
    host_rate = (F.col("host_s") - F.col("y") + m_host * rate) / (F.col("host_n") - 1 + m_host)
    path_rate = (F.col("s") - F.col("y") + m_path * F.col("host_rate")) / (F.col("n") - 1 + m_path)
    site = rows.join(sites, ["host", "path"]).withColumn("host_rate", host_rate).withColumn("path_rate", F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), path_rate)))
    odds = _logit(F.col("evidence")) - float(np.log(rate / (1 - rate))) + _logit(F.col("path_rate"))
    if not model.weights:
        odds = _logit(F.lit(0.5))
    out = site.withColumn("score", 1 / (1 + F.exp(-odds)))
    return out.select("doc_id", "row", "host", "path", "evidence", "host_rate", "path_rate", "score", (F.col("score") >= threshold).alias("keep"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs to keep by quality_scores(); all their columns stay."""
    return without_rows(docs, written(quality_scores(docs, labels).where(~F.col("keep")).select("doc_id", "row"), "rejected"))


def page_digest(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of web pages (page_id, url, html) by hosts and first path segments of their URLs, under the classifier of docs."""
    text = F.regexp_replace("html", r"(?is)<(script|style)\b[^>]*+>.*?</\1>|<[^>]*+>", " ")
    rows = pages.select(F.col("page_id").alias("doc_id"), text.alias("text"), "url")
    scores = quality_scores(rows, labels, url_host(F.col("url")), url_path(F.col("url")), fitted_on=docs)
    return scores.drop("row").withColumnRenamed("doc_id", "page_id")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality_scores(docs, labels).drop("row")
