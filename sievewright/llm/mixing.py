"""Problem 6: mixing sources to target weights by soft domain membership.

A naive Bayes classifier over hashed words, counted over all labelled
documents, gives each document posteriors over the mixtures' domains; a long
text counts as EVIDENCE independent words at most, so that it stays soft.
For every release, projected gradient descent on a least-squares objective
fits a nonnegative rate of use for each document, at most the component's cap,
such that expected sizes match the component targets, each weighted by its
sample weight, and the domain targets. A step depends on a document's
component and (quantized) posterior only, so documents of one cell share their
rate; the releases are solved apart, in parallel, each until its steps no
longer change the objective. The rates of a component are then scaled to its
target, which keeps the tilt between domains. Rates become whole uses by a
hash threshold that a distributed histogram sets so that the component's size
comes as close to its target as documents allow.

Texts are read twice, to count the classifier and to classify; all that
follows is built-in expressions over (component, document, size, posterior).
What is collected or broadcast is bounded by release_mixture (a configuration
table), the number of its domains, the levels of the posteriors and the
histogram's bins.

Defined results: a component whose documents at their cap are too small gets
all of them at the cap and its shortfall is reported; a source of several
components of one release gives each document to just one of them by hash, so
no document passes its cap; sources without documents add nothing; a null
n_chars counts the text's code points; empty documents are never used; a null
share counts as 0, a null cap as 1 and a null sample weight as 1; documents
without id are not used; components of the domain "mixed" or of none ask for
no domain.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from sievewright.llm.budget import spelled
from sievewright.llm.leak import worded
from sievewright.tables import spread, written

BUCKETS = 1 << 12
EVIDENCE = 16  # independent words that a text counts as at most
LEVELS = 8  # posteriors are kept in eighths
DOMAIN_WEIGHT = 0.3  # of the domain targets beside the components'
STEPS, SETTLED = 3000, 1e-12  # most steps, and the change of the objective that ends them before
BINS, TOP = 2048, 4.0


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, word bucket) of all words."""
    h, bounds = worded(texts)
    return np.repeat(np.arange(len(texts)), np.diff(bounds)), (h >> np.uint64(52)).astype(np.int64)


def fit_domains(docs: DataFrame, domains: list[str], text_col: str = "text", label_col: str = "doc_domain") -> np.ndarray:
    """log P(word bucket | domain) in rows, the last row for all other labels."""
    place = {d: i for i, d in enumerate(domains)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(domains) + 1, BUCKETS), dtype=np.int64)
        for batch in batches:
            label = np.array([place.get(x, len(domains)) for x in batch.column(0).to_pylist()], dtype=np.int64)
            text, bucket = _counts(batch.column(1).to_pylist())
            seen += np.bincount(label[text] * BUCKETS + bucket, minlength=seen.size).reshape(seen.shape)
        d, b = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(d.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(seen[d, b])], names=["d", "b", "n"])

    labelled = docs.select(spelled(docs[label_col]).alias("label"), docs[text_col].cast("string").alias("text")).where(docs[label_col].isNotNull() & docs[text_col].isNotNull())
    rows = spread(labelled).mapInArrow(count, "d int, b int, n long").groupBy("d", "b").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros((len(domains) + 1, BUCKETS))
    seen[rows["d"], rows["b"]] = rows["n"]
    return np.log((seen + 0.5) / (seen.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32)


def posteriors(texts: list[str], log_words: np.ndarray) -> np.ndarray:
    """Posterior of each text in LEVELS-ths that sum to LEVELS."""
    text, bucket = _counts(texts)
    n = np.bincount(text, minlength=len(texts))
    score = np.stack([np.bincount(text, weights=row[bucket], minlength=len(texts)) for row in log_words], axis=1)
    score = score / np.maximum(n / EVIDENCE, 1)[:, None]
    p = np.exp(score - score.max(axis=1, keepdims=True)) if len(texts) else score
    exact = p / p.sum(axis=1, keepdims=True) * LEVELS if len(texts) else p
    q = np.floor(exact).astype(np.int64)
    rank = np.argsort(np.argsort(q - exact, axis=1, kind="stable"), axis=1, kind="stable")
    return q + (rank < (LEVELS - q.sum(axis=1))[:, None])


class Plan:
    """The mixture table as arrays."""

    def __init__(self, rows: list[Row], total: int):
        self.rows = sorted(rows, key=lambda r: (r.release_id or "", r.mixture_name or ""))
        self.releases = sorted({r.release_id or "" for r in self.rows})
        self.release = np.array([self.releases.index(r.release_id or "") for r in self.rows], dtype=np.int64)
        self.domains = sorted({r.domain for r in self.rows} - {"mixed", "unknown"})
        self.domain = np.array([self.domains.index(r.domain) if r.domain in self.domains else -1 for r in self.rows], dtype=np.int64)
        self.cap = np.array([max(1, r.max_repeats if r.max_repeats is not None else 1) for r in self.rows], dtype=np.float64)
        self.weight = np.array([r.sample_weight if r.sample_weight is not None and r.sample_weight > 0 else 1.0 for r in self.rows])
        self.target = np.array([(r.target_share or 0.0) * (r.size_ratio or 0.0) * total for r in self.rows])
        self.of_source: dict[str, dict[int, list[int]]] = {}
        for c, r in enumerate(self.rows):
            for source in dict.fromkeys(r.source_ids or []):
                self.of_source.setdefault(source, {}).setdefault(int(self.release[c]), []).append(c)
        self.wanted = np.zeros((len(self.releases), len(self.domains) + 1))  # the last column is text of other domains
        for c in np.flatnonzero(self.domain >= 0):
            self.wanted[self.release[c], self.domain[c]] += self.target[c]

    def components(self, source: str, doc_id: int) -> list[int]:
        out = []
        for same in self.of_source.get(source, {}).values():
            out.append(same[0] if len(same) == 1 else same[zlib.crc32(b"%d" % doc_id) % len(same)])
        return out

    def solve(self, release: int, c: np.ndarray, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, int, float]:
        """Rate of each cell (component c, posterior p, size n) of a release, number of steps and last gradient."""
        parts = np.flatnonzero(self.release == release)
        size = max(float(self.target[parts].sum()), 1.0)
        weight = np.sqrt(self.weight[parts] / self.weight[parts].mean())
        own = self.domain[c] >= 0
        rows = [w * (c == k) for w, k in zip(weight, parts, strict=True)] + [np.sqrt(DOMAIN_WEIGHT) * p[:, d] * own for d in range(p.shape[1])]
        m = np.array(rows, dtype=np.float64) / size  # one row for each target
        b = np.r_[weight * self.target[parts], np.sqrt(DOMAIN_WEIGHT) * self.wanted[release]] / size
        available = np.bincount(c, weights=n, minlength=len(self.rows))
        r = np.minimum(self.target[c] / np.maximum(available[c], 1), self.cap[c])
        step = 1 / max(np.linalg.eigvalsh((m * n) @ m.T)[-1], 1e-12) / size if len(n) else 0.0
        ahead, t, last, steps, gradient = r, 1.0, np.inf, 0, 0.0
        while steps < STEPS and len(n):
            steps += 1
            g = (m.T @ (m @ (ahead * n) - b)) * size
            now = np.clip(ahead - step * g, 0.0, self.cap[c])
            t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead, r, t = now + (t - 1) / t_next * (now - r), now, t_next
            value = float(((m @ (r * n) - b) ** 2).sum())
            gradient = float(np.abs(r - np.clip(r - step * (m.T @ (m @ (r * n) - b)) * size, 0.0, self.cap[c])).max())
            if abs(last - value) <= SETTLED * max(value, 1e-9) and gradient < 1e-6:
                break
            last = value
        for k in parts:  # the component's own target is kept, the tilt between its cells stays
            at = np.flatnonzero(c == k)
            if len(at):
                r[at] = scaled(r[at], n[at], self.cap[k], self.target[k])
        return r, steps, gradient


def scaled(r: np.ndarray, n: np.ndarray, cap: float, target: float) -> np.ndarray:
    """The rates times one factor, at most the cap, such that the size is the target if it can be."""
    if target <= 0:
        return np.zeros_like(r)
    r = np.maximum(r, 1e-9)
    if (cap * n).sum() <= target:
        return np.full_like(r, cap)
    low, high = 0.0, cap / r.min()
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (np.minimum(r * mid, cap) * n).sum() < target else (low, mid)
    return np.minimum(r * high, cap)


MEMBERS = "component int, doc_id long, chars long, posterior array<int>"


def members(docs: DataFrame, plan: Plan, log_words: np.ndarray) -> DataFrame:
    """Each document once for every component it may serve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, at, texts = [], [], []
            for doc, source, chars, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                parts = plan.components(source, doc) if doc is not None else []
                n = chars if chars is not None else len(text or "")
                if parts and n > 0:
                    out += [(c, doc, n) for c in parts]
                    at += [len(texts)] * len(parts)
                    texts.append(text or "")
            q = posteriors(texts, log_words)[np.array(at, dtype=np.int64)] if texts else np.zeros((0, 1), np.int64)
            columns = list(zip(*out, strict=True)) if out else [[]] * 3
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * q.shape[1], pa.int32()), pa.array(q.reshape(-1), pa.int32()))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)), lists], names=["component", "doc_id", "chars", "posterior"])

    return spread(docs.select(docs["doc_id"].cast("long"), docs["source"].cast("string"), docs["n_chars"].cast("long"), docs["text"].cast("string"))).mapInArrow(run, MEMBERS)


RATES = "component int, posterior array<int>, chars long, rate double, steps long, gradient double"


class Mixture:
    """Fitted rates and the documents that are used."""

    def __init__(self, docs: DataFrame, mixtures: DataFrame):
        rows = mixtures.withColumn("domain", spelled(F.col("mixture_domain"))).collect()  # a configuration table
        total = docs.agg(F.sum(F.coalesce("n_chars", F.char_length("text")))).first()[0] or 0
        self.plan = plan = Plan(rows, total)
        self.spark = docs.sparkSession
        held = written(members(docs, plan, fit_domains(docs, plan.domains)), "members")
        self.names = self.spark.createDataFrame(
            [(c, r.release_id, r.mixture_name, r.mixture_domain, r.target_share, r.sample_weight, float(plan.target[c]), int(plan.cap[c]), int(plan.release[c]), bool(plan.domain[c] >= 0)) for c, r in enumerate(plan.rows)],
            "component int, release_id string, mixture_name string, mixture_domain string, target_share double, sample_weight double, target_chars double, max_repeats int, release int, asks boolean",
        )
        cells = held.groupBy("component", "posterior").agg(F.sum("chars").alias("chars")).join(F.broadcast(self.names.select("component", "release")), "component")

        def solve(got: pd.DataFrame) -> pd.DataFrame:
            c = got["component"].to_numpy(dtype=np.int64)
            p = np.stack(got["posterior"].to_numpy()).astype(np.float64) / LEVELS
            rate, steps, gradient = plan.solve(int(got["release"].iloc[0]), c, p, got["chars"].to_numpy(dtype=np.float64))
            return pd.DataFrame({"component": got["component"], "posterior": got["posterior"], "chars": got["chars"], "rate": rate, "steps": steps, "gradient": gradient})

        self.rates = written(cells.groupBy("release").applyInPandas(solve, RATES), "rates")
        self.used = self._whole_uses(held)

    def _whole_uses(self, held: DataFrame) -> DataFrame:
        """(component, doc_id, chars, posterior, uses) of every used document."""
        parts, plan = len(self.plan.rows), self.plan
        # one row a cell: bounded by the mixtures and the levels of the posteriors
        d = held.join(F.broadcast(self.rates.select("component", "posterior", "rate")), ["component", "posterior"]).join(F.broadcast(self.names.select("component", "max_repeats")), "component")
        whole = F.floor(F.col("rate") + 1e-9)
        uniform = F.shiftrightunsigned(F.xxhash64("component", "doc_id"), 11) / float(1 << 53)
        position = F.log1p(uniform / F.greatest(F.col("rate") - whole, F.lit(1e-9))) / float(np.log(2))  # 1 is where the fitted rate ends
        k = F.least(F.floor(F.least(position, F.lit(TOP)) / TOP * BINS), F.lit(BINS - 1))
        d = d.select("component", "doc_id", "chars", "posterior", whole.alias("whole"), F.when(whole < F.col("max_repeats"), k).alias("k"))
        sums = d.groupBy("component", "k").agg(F.sum(F.col("chars") * F.col("whole")).alias("sure"), F.sum("chars").alias("extra")).toPandas()
        sure, extra = np.zeros(parts), np.zeros((parts, BINS))
        np.add.at(sure, sums["component"].to_numpy(dtype=np.int64), sums["sure"].to_numpy(dtype=np.float64))
        some = sums[sums["k"].notna()]
        extra[some["component"].to_numpy(dtype=np.int64), some["k"].to_numpy(dtype=np.int64)] = some["extra"]
        reach = np.c_[sure, sure[:, None] + np.cumsum(extra, axis=1)]
        threshold = np.abs(reach - plan.target[:, None]).argmin(axis=1)
        limits = self.spark.createDataFrame([(c, int(t)) for c, t in enumerate(threshold)], "component int, threshold long")
        d = d.join(F.broadcast(limits), "component").withColumn("uses", (F.col("whole") + F.coalesce(F.col("k") < F.col("threshold"), F.lit(False)).cast("long")).cast("long"))
        return d.where("uses > 0").select("component", "doc_id", "chars", "posterior", "uses")


def selection(docs: DataFrame, mixtures: DataFrame) -> DataFrame:
    """(release_id, mixture_name, doc_id, uses)."""
    m = Mixture(docs, mixtures)
    return m.used.join(F.broadcast(m.names), "component").select("release_id", "mixture_name", "doc_id", "uses")


def report(docs: DataFrame, mixtures: DataFrame) -> DataFrame:
    """Target and actual share of every component, and the steps that fitted its release."""
    m = Mixture(docs, mixtures)
    sums = m.used.groupBy("component").agg(F.sum(F.col("chars") * F.col("uses")).alias("actual_chars"), F.count(F.lit(1)).alias("documents"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"))
    fits = m.rates.groupBy("component").agg(F.sum(F.col("rate") * F.col("chars")).alias("expected_chars"), F.max("steps").alias("steps"), F.max("gradient").alias("last_gradient"))
    named = m.names.join(sums, "component", "left").join(fits, "component", "left").na.fill(0, ["actual_chars", "documents", "uses", "most_uses", "expected_chars"])
    of = Window.partitionBy("release_id")
    return named.select(
        "release_id", "mixture_name", "mixture_domain", "target_share", "sample_weight", "target_chars", "expected_chars", "actual_chars",
        (F.col("actual_chars") / F.nullif(F.sum("actual_chars").over(of), F.lit(0))).alias("actual_share"),
        (F.col("actual_chars") / F.nullif(F.col("target_chars"), F.lit(0.0))).alias("reached"),
        "documents", "uses", "most_uses", "max_repeats", "steps", "last_gradient",
    )


def domain_report(docs: DataFrame, mixtures: DataFrame) -> DataFrame:
    """Of every release and domain the target size, the size expected under the fitted rates and the actual size.

    Sizes are sums over documents of posterior times size; the domain of text
    that no component asks for is "other"; components of no domain are left out.
    """
    m = Mixture(docs, mixtures)
    plan = m.plan
    asks = F.broadcast(m.names.where("asks").select("component", "release"))
    share = F.col("q") / float(LEVELS)
    of = lambda d, size: d.join(asks, "component").select("release", F.posexplode("posterior").alias("domain", "q"), size.alias("size")).groupBy("release", "domain")
    expected = of(m.rates, F.col("rate") * F.col("chars")).agg(F.sum(share * F.col("size")).alias("expected_chars"))
    actual = of(m.used, F.col("uses") * F.col("chars")).agg(F.sum(share * F.col("size")).alias("actual_chars"))
    wanted = [(i, d, plan.releases[i], (*plan.domains, "other")[d], float(x)) for i, row in enumerate(plan.wanted) for d, x in enumerate(row)]
    named = m.spark.createDataFrame(wanted, "release int, domain int, release_id string, domain_name string, target_chars double")
    out = named.join(expected, ["release", "domain"], "left").join(actual, ["release", "domain"], "left").na.fill(0.0, ["expected_chars", "actual_chars"])
    whole = F.nullif(F.sum("target_chars").over(Window.partitionBy("release")), F.lit(0.0))
    return out.select("release_id", "domain_name", "target_chars", "expected_chars", "actual_chars", ((F.col("expected_chars") - F.col("target_chars")) / whole).alias("residual"))
