"""Quality classification by importance resampling.

Two bags of hashed n-grams (words and pairs of neighbouring words, ``BUCKETS`` buckets) are counted: one over the
target documents, one over all documents. A document's log importance weight is the sum over its
n-grams of log p(target) - log p(raw), by which documents are drawn without replacement: add Gumbel noise
and keep the k largest. With ``weight="tempered"``, a named option that the query and the pipeline take, the sum is divided by
the n-grams (plus a prior that holds short texts near 0) and multiplied by ``SHARPNESS``: else length decides
more than quality, as a long clean text's sum lies far below a short one's. k is how many documents reach the weight that all
but ``LOSS`` of the held-out target documents reach, so clean text stays.

The target model is fitted on a bounded sample of labelled documents: ``MAX_LABELLED`` ids with the smallest hashes, a
fifth of them held out. The raw model, the scores and the selection cover all rows. What leaves the executors is of fixed size: the
two histograms, the sampled ids, and the selection's histograms of keys. Texts are never shuffled.

Defined results: a null or wordless text has weight 0; an id with several labels is a target only if
all say so; without target documents all weights are 0 and everything is kept; rows are judged each by its own
text; keys that tie with the k-th (to a millionth) are kept with it; names starting with ``__td_`` are reserved.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, frugal, id_column, restored
from tidemark.llm.texthash import mix, word_hashes

BUCKETS = 1 << 18
MAX_LABELLED = 100_000
PRIOR = 20.0
SHARPNESS = 100.0
LOSS = 0.005
SMOOTHING = 1.0
SEED = 20_240_229
_BLOCK = 4096
_BINS = 4096


def ngram_buckets(texts: pa.Array, buckets: int = BUCKETS):
    """(bucket of every n-gram, its document's number in the slice, documents of the slice), slice by slice."""
    for hashes, per_doc in word_hashes(texts):
        doc = np.repeat(np.arange(len(per_doc)), per_doc)
        pair = mix(hashes[:-1] * np.uint64(3) + hashes[1:])
        inside = doc[1:] == doc[:-1]
        one = (hashes % np.uint64(buckets)).astype(np.int64)
        two = (pair[inside] % np.uint64(buckets)).astype(np.int64)
        yield np.concatenate((one, two)), np.concatenate((doc, doc[1:][inside])), len(per_doc)


def _counted(target: np.ndarray, buckets: int):
    """Raw and target histograms of a partition, as blocks."""

    def of(batches):
        raw, own = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            chosen, at = np.isin(ids, target), 0
            for bucket, doc, n in ngram_buckets(batch.column(1), buckets):
                raw += np.bincount(bucket, minlength=buckets)
                own += np.bincount(bucket[chosen[at + doc]], minlength=buckets)
                at += n
        some = np.flatnonzero(raw)
        for k in range(0, len(some), 10_000):
            part = some[k : k + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(raw[part]), pa.array(own[part])], names=["bucket", "raw", "own"]
            )

    return of


@dataclass(frozen=True)
class Model:
    """``ratio``: log p(target) - log p(raw) of each bucket; ``least``: the calibrated value, None without targets."""

    ratio: np.ndarray
    least: float | None


def labelled_targets(labels: DataFrame, most: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """(ids to fit on, ids held out), of at most ``most`` target documents, chosen by the hash of their id."""
    good = (
        labels.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
        .where("q = 1 and t = 0")
    )
    hashed = good.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("doc_id", F.lit(SEED)).alias("h"))
    rows = hashed.orderBy("h", "id").limit(most).collect()
    ids = np.array([r["id"] for r in rows], np.int64)
    held = np.array([r["h"] % 5 == 0 for r in rows], bool)
    return ids[~held], ids[held]


def _scorer(ratio: np.ndarray):
    shared = ratio.astype(np.float32)

    @F.arrow_udf("struct<n:bigint,s:double>")
    def score(texts: pa.Array) -> pa.Array:
        n, s = [], []
        for bucket, doc, docs in ngram_buckets(texts, len(shared)):
            n.append(np.bincount(doc, minlength=docs))
            s.append(np.bincount(doc, weights=shared[bucket], minlength=docs))
        size = np.concatenate(n) if n else np.zeros(0, np.int64)
        total = np.concatenate(s) if s else np.zeros(0)
        return pa.StructArray.from_arrays([pa.array(size, pa.int64()), pa.array(total, pa.float64())], ["n", "s"])

    return score


def fit(
    docs: DataFrame, labels: DataFrame, *, text: str = "text", buckets: int = BUCKETS, weight: str = "summed"
) -> Model:
    """Counts both models and calibrates ``least`` on the held-out target documents."""
    chosen, held = labelled_targets(labels)
    if not len(chosen):
        return Model(np.zeros(buckets), None)
    rows = (
        docs.select(id_column(docs), F.col(text))
        .mapInArrow(frugal(_counted(np.sort(chosen), buckets)), "bucket long, raw long, own long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("own").alias("own"))
        .toArrow()
    )
    raw, own = np.zeros(buckets), np.zeros(buckets)
    at = rows.column("bucket").to_numpy()
    raw[at], own[at] = rows.column("raw").to_numpy(), rows.column("own").to_numpy()
    p_raw = (raw + SMOOTHING * raw.sum() / max(raw.sum(), 1) / buckets) / (raw.sum() + SMOOTHING)
    p_own = (own + SMOOTHING * p_raw * buckets) / (own.sum() + SMOOTHING * buckets)
    ratio = np.zeros(buckets)
    seen = raw > 0
    ratio[seen] = np.log(p_own[seen]) - np.log(p_raw[seen])
    few = docs.sparkSession.createDataFrame(pa.table({"__td_held": pa.array(held, pa.int64())}))
    # bounded: at most MAX_LABELLED ids
    checked = docs.join(F.broadcast(few), id_column(docs) == F.col("__td_held"), "left_semi")
    values = checked.select(log_weight(_scorer(ratio)(F.col(text)), weight).alias("v")).toArrow().column("v").to_numpy()
    return Model(ratio, least_weight(values) if len(values) else None)


def least_weight(values: np.ndarray) -> float:
    """What all but ``LOSS`` of the held-out targets reach. Too few of them to show that share tell it by mean and spread."""
    least = float(np.quantile(values, LOSS))
    if len(values) * LOSS >= 1:
        return least
    return min(least, float(values.mean() + NormalDist().inv_cdf(LOSS) * values.std()))


WEIGHTS = ("summed", "tempered")


def log_weight(scored: Column, weight: str = "summed") -> Column:
    """The log weight of the draw: the sum of the log ratios, or their sharpened mean."""
    if weight not in WEIGHTS:
        raise ValueError(f"{weight} is none of {WEIGHTS}")
    return scored["s"] if weight == "summed" else SHARPNESS * scored["s"] / (scored["n"] + F.lit(PRIOR))


def gumbel_key(log_weight: Column, identity: Column) -> Column:
    """The key of the draw, in millionths: the log weight and Gumbel noise from a hash of the id."""
    uniform = (F.shiftrightunsigned(F.xxhash64(identity, F.lit(SEED)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.round((log_weight - F.log(-F.log(uniform))) * 1e6).cast("long")


def kth_largest(keys: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest of a column of longs, by a histogram of its range that is refined until a bin is one
    value; None if there are fewer than k."""
    ends = keys.agg(F.min(column).alias("a"), F.max(column).alias("b"), F.count(column).alias("n")).first()
    if k <= 0 or ends["n"] < k:
        return None
    low, high = ends["a"], ends["b"]
    while low < high:
        width = -(-(high - low + 1) // _BINS)
        bin_of = F.floor((F.col(column) - F.lit(low)) / F.lit(width)) if width > 1 else F.col(column) - F.lit(low)
        bins = (
            keys.where((F.col(column) >= low) & (F.col(column) <= high))
            .groupBy(bin_of.cast("long").alias("bin"))
            .agg(F.count("*").alias("n"))
            .collect()
        )
        for row in sorted(bins, key=lambda r: -r["bin"]):
            if k <= row["n"]:
                low, high = low + row["bin"] * width, min(high, low + (row["bin"] + 1) * width - 1)
                break
            k -= row["n"]
    return low


def resample(
    docs: DataFrame, labels: DataFrame, *, text: str = "text", k: int | None = None, weight: str = "summed"
):
    """(scored: id, n_ngrams, log_weight, draw_weight, gumbel_key, kept; what filters rows of ``docs``).

    ``k`` overrides the calibrated number of documents; ``draw_weight`` is the log weight of the draw.
    """
    model = fit(docs, labels, text=text, weight=weight)
    score = _scorer(model.ratio)(F.col(text))
    scored = cut(
        docs.select(id_column(docs).alias("id"), score.alias("x"))
        .select("id", F.col("x.n").alias("n_ngrams"), F.col("x.s").alias("log_weight"), log_weight(F.col("x"), weight).alias("draw_weight"))
        .withColumn("gumbel_key", gumbel_key(F.col("draw_weight"), F.col("id"))),
        "importance",
    )
    if k is None and model.least is not None:
        k = scored.where(F.col("draw_weight") >= F.lit(model.least)).count()
    least = None if k is None else kth_largest(scored, "gumbel_key", k)
    if k is not None and k <= 0:
        verdict = lambda key: F.lit(False)
    elif least is None:
        verdict = lambda key: F.lit(True)
    else:
        verdict = lambda key: key >= F.lit(least)
    keeps = verdict(gumbel_key(log_weight(score, weight), id_column(docs)))
    return scored.withColumn("kept", verdict(F.col("gumbel_key"))), keeps


def quality_filter(docs: DataFrame, labels: DataFrame, *, text: str = "text", weight: str = "tempered") -> DataFrame:
    """The rows of ``docs`` that the draw keeps, in all their columns."""
    _, keeps = resample(docs, labels, text=text, weight=weight)
    return docs.withColumn("__td_keeps", keeps).where("__td_keeps").drop("__td_keeps")


def op2_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """Importance weight, key and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored, _ = resample(docs, labels, weight="tempered")
    return scored.select(
        restored(F.col("id")).alias("doc_id"), "n_ngrams", "log_weight", "draw_weight",
        (F.col("gumbel_key") / 1e6).alias("gumbel_key"), "kept",
    )
