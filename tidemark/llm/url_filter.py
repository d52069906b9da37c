"""URL filtering by rules, and beyond them by a ratio of character language models.

Rules name a host and a path prefix; a rule fits its host and all subdomains, and the longest fitting rule decides. The
URLs that rules accept and reject train one model each: variable-order Markov models of characters, contexts of up to ``ORDER``
characters, interpolated by Witten and Bell's rule down to a uniform distribution. A URL that no rule fits is
judged by the difference of its log-likelihoods per character against a threshold calibrated on held-out URLs.

The models are fitted on a bounded sample of labelled URLs: the ``MAX_TRAINING`` distinct ones of each class with the smallest
hashes, each weighing as many as its rows, a fifth of them held out for the threshold (none, if a class has no others).
A model is two sorted arrays, of contexts and of contexts with a character, by 64-bit hashes; a slice of URLs is scored by one search
for each length of context over its distinct n-grams. Labelled URLs are aggregated once; every row is judged in place, and a
frequent host costs what its rows cost.

Defined results: a null URL, or one without ``://``, has an empty host and path; then the empty text is judged; if either class
has no URLs to train on, what no rule fits is allowed; rows are judged each by itself; columns named like the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower
from tidemark.llm.texthash import _ODD, mix

#: (verdict, host, path prefix); a list that fits into the plan, a thousand at most.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER = 5
MAX_TRAINING = 20_000
SEED = 4_000_037
START, STOP = "\x02", "\x03"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def _longest(rules: Sequence[tuple[str, str, str]], host: Column, path: Column, value) -> Column:
    """The value of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def _characters(texts: Sequence[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts, start marks before each and a stop behind; places of what is to be predicted; how many each text has)."""
    joined = "".join([START * order + t + STOP for t in texts])
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    text = np.repeat(np.arange(1, len(texts) + 1), size)
    return points, np.arange(int(size.sum())) + order * text, size


def _contexts(points: np.ndarray, at: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """Hashes of the contexts of 0 to ``order`` characters before each place, the shortest first."""
    value = np.ones(len(at), np.uint64)
    yield value
    for size in range(1, order + 1):
        value = mix(value * _ODD + points[at - size].astype(np.uint64))
        yield value


def _grams(context: np.ndarray, points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of contexts with the character behind them."""
    return mix(mix(context + _ODD) ^ points[at].astype(np.uint64))


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of keys, 0 where there is none; keys are sorted."""
    if not len(keys):
        return np.zeros((len(wanted), *values.shape[1:]), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return np.where(hit if values.ndim == 1 else hit[:, None], values[at], 0)


class MarkovModel:
    """Counts of characters after contexts, and their interpolated probabilities."""

    def __init__(self, texts: Sequence[str], weights: Sequence[int], order: int = ORDER):
        self.order = order
        points, at, size = _characters(texts, order)
        weight = np.repeat(np.asarray(weights, np.int64), size)
        grams, contexts = [], []
        for context in _contexts(points, at, order):
            grams.append(_grams(context, points, at))
            contexts.append(context)
        weight = np.tile(weight, order + 1)
        gram, context = np.concatenate(grams), np.concatenate(contexts)
        self.gram, one, back = np.unique(gram, return_index=True, return_inverse=True)
        self.count = np.bincount(back, weights=weight, minlength=len(one)).astype(np.int64)
        self.context, back = np.unique(context[one], return_inverse=True)
        #: of each context the characters seen after it, all and distinct
        self.sums = np.zeros((len(self.context), 2), np.int64)
        np.add.at(self.sums[:, 0], back, self.count)
        np.add.at(self.sums[:, 1], back, 1)
        kinds = _found(self.context, self.sums, np.ones(1, np.uint64))[0, 1]
        self.uniform = 1.0 / (kinds + 1)

    def probabilities(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the character at each place, after what stands before it. A context longer than an unknown one is unknown too."""
        p = np.full(len(at), self.uniform)
        for context in _contexts(points, at, self.order):
            total, kinds = _found(self.context, self.sums, context).T
            seen = _found(self.gram, self.count, _grams(context, points, at))
            p = np.where(total > 0, (seen + kinds * p) / np.maximum(total + kinds, 1), p)
        return p


class RatioModel:
    def __init__(self, accepted: MarkovModel, rejected: MarkovModel, threshold: float = 0.0):
        self.accepted, self.rejected, self.threshold = accepted, rejected, threshold

    def scores(self, texts: Sequence[str], step: int = 4096) -> np.ndarray:
        """Differences of the log-likelihoods, a character (with its stop)."""
        out = [np.zeros(0)]
        order = self.accepted.order
        for begin in range(0, len(texts), step):
            points, at, size = _characters(texts[begin : begin + step], order)
            *_, context = _contexts(points, at, order)
            _, one, back = np.unique(_grams(context, points, at), return_index=True, return_inverse=True)
            some = at[one]
            gain = np.log(self.accepted.probabilities(points, some)) - np.log(self.rejected.probabilities(points, some))
            out.append(np.add.reduceat(gain[back], np.cumsum(size) - size) / size)
        return np.concatenate(out)

    def score(self, text: str) -> float:
        return float(self.scores([text])[0])


def calibrate(model: RatioModel, accepted: dict[str, int], rejected: dict[str, int]) -> float:
    """The threshold with the best balanced accuracy, in the middle between the scores it separates; texts have weights."""
    if not accepted or not rejected:
        return 0.0
    scores = model.scores([*accepted, *rejected])
    weight = np.array([*accepted.values(), *rejected.values()], np.int64)
    good = np.arange(len(scores)) < len(accepted)
    order = np.argsort(scores, kind="stable")
    scores, good, bad = scores[order], (weight * good)[order], (weight * ~good)[order]
    # threshold below the k-th score: those from k on are allowed
    hits = 1 - np.concatenate(([0], np.cumsum(good))) / good.sum()
    misses = np.concatenate(([0], np.cumsum(bad))) / bad.sum()
    same = np.concatenate(([False], scores[1:] == scores[:-1], [False]))
    best = int(np.argmax(np.where(same, -1.0, hits + misses)))
    if best == 0:
        return float(scores[0])
    if best == len(scores):
        return float(np.nextafter(scores[-1], np.inf))
    return float((scores[best - 1] + scores[best]) / 2)


def fit(labelled: DataFrame, *, order: int = ORDER, most: int = MAX_TRAINING) -> RatioModel | None:
    """A model from ``label`` (allow, block) and ``text``; None if a class is missing."""
    distinct = labelled.groupBy("label", "text").agg(F.count("*").alias("weight"))
    models, held = {}, {}
    for label in ("allow", "block"):
        one = distinct.where(F.col("label") == label).withColumn("h", F.xxhash64("text", F.lit(SEED)))
        rows = one.orderBy("h", "text").limit(most).collect()
        held[label] = {r["text"]: r["weight"] for r in rows if r["h"] % 5 == 0}
        own = {r["text"]: r["weight"] for r in rows if r["h"] % 5}
        if not own:
            own, held[label] = held[label], {}
        if own:
            models[label] = MarkovModel(list(own), list(own.values()), order)
    if len(models) < 2:
        return None
    model = RatioModel(models["allow"], models["block"])
    model.threshold = calibrate(model, held["allow"], held["block"])
    return model


def filter_urls(pages: DataFrame, *, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` and ``score`` (null where a rule decides or there is no model)."""
    outputs = ["host", "path", "rule", "verdict", "score"]
    own = [c for c in pages.columns if c not in outputs or c == url]
    host, path = host_and_path(pages[url])
    # not deterministic: without it, the filter below would be pushed down with the host written out in every rule
    barrier = F.monotonically_increasing_id().alias("__td_barrier")
    split = pages.select(*own, host.alias("__td_host"), path.alias("__td_path"), barrier)
    host, path = F.col("__td_host"), F.col("__td_path")
    marked = split.withColumns(
        {
            "__td_rule": _longest(rules, host, path, lambda r: r[1] + r[2]),
            "__td_verdict": _longest(rules, host, path, lambda r: r[0]),
            "__td_text": F.concat(host, path),
        }
    )
    labelled = marked.where("__td_verdict is not null and __td_barrier >= 0").select(
        F.col("__td_verdict").alias("label"), F.col("__td_text").alias("text")
    )
    model = fit(labelled)
    if model is None:
        score, verdict = F.lit(None).cast("double"), F.lit("allow")
    else:
        shared = pages.sparkSession.sparkContext.broadcast(model)

        @F.arrow_udf("double")
        def score_of(texts: pa.Array) -> pa.Array:
            asked = texts.is_valid().to_numpy(zero_copy_only=False)
            out = np.full(len(texts), np.nan)
            out[asked] = shared.value.scores([t for t in texts.to_pylist() if t is not None])
            return pa.array(out, pa.float64(), mask=~asked)

        score = score_of(F.when(F.col("__td_verdict").isNull(), F.col("__td_text")))
        verdict = F.when(F.col("__td_score") >= F.lit(model.threshold), "allow").otherwise("block")
    return marked.withColumn("__td_score", score).select(
        *[c for c in own if c not in outputs],
        F.col("__td_host").alias("host"),
        F.col("__td_path").alias("path"),
        F.col("__td_rule").alias("rule"),
        F.coalesce("__td_verdict", verdict).alias("verdict"),
        F.col("__td_score").alias("score"),
    )


def op4_url_markov(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")
