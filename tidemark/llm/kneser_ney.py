"""Interpolated modified Kneser-Ney n-gram model, counted in Spark, stored as sorted hash arrays that workers map.

1. Word hashes of the training texts are counted a task at a time and merged by ranges of the hash; every
   range is written as a sorted array, so a word's id is its place in all ranges together.
2. N-grams of ids are counted a task at a time and merged by a hash of the n-gram, so that a frequent context or
   word is spread over all shards; every shard is written as a sorted array of hashes and their counts. It passes on,
   already summed, what its n-grams add to their contexts, and how many of them end in each (n-1)-gram.
3. Those continuation counts make the next lower order by the same step, down to single words.

Discounts (D1, D2, D3+) of every order come from its counts of counts, the only numbers the driver sees besides the
sizes of the shards. Scoring maps the arrays (page cache, not heap), looks up each slice's distinct n-grams by
binary search, a shard after the other, and never shuffles. A text is its words and one end, behind ``order - 1`` start marks.

p(w|uv) = max(c(uvw) - D(c(uvw)), 0) / c(uv.) + g(uv) p(w|v), and so on down, where c are counts in the highest order and numbers
of distinct words before the n-gram in the lower ones; single words are interpolated with 1 / (V + 1), which is all that an
unknown word gets; an unknown context leaves the lower order's probability.

The files stand in the shared folder (``spark.checkpoint.dir``), which must be mounted (a ``file:`` path) as workers map them;
they are written under another name and renamed, so a repeated task does no harm. Counts and sums have 64 bits where they need
them, ids 32 or 64 as the vocabulary asks; n-grams are told apart by hashes of 64 bits.

Defined results: a null text is empty (its end alone); without training tokens every word is unknown and a text of n
tokens scores 0 n (V is 0, all mass on the unknown word); rows are judged each by its own text and id; a null id has the text ''.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import frugal
from tidemark.llm.texthash import _ODD, mix, word_hashes
from tidemark.shared import mounted, shared_dir

#: Stands for the end of a text among the word hashes.
END = np.uint64(0xE17A1B2C3D4E5F60)
ORDER = 2
#: Tokens that a task counts at once, tokens that it scores at once, and entries of a shard, about.
FLUSH = 2_000_000
SLICE = 250_000
SHARD = 2_000_000
#: Files that a worker holds mapped.
MAPPED = 128


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def _save(path: str, values: np.ndarray) -> None:
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as out:
        np.save(out, values)
    os.replace(own, path)


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _blocks(shard: np.ndarray, *columns: np.ndarray, kind: str = "") -> Iterator[pa.RecordBatch]:
    """The columns, dealt by shard: one packed row a shard."""
    order = np.argsort(shard, kind="stable")
    shard, columns = shard[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(shard))
    names = ["kind", "shard", "n", "block"]
    for at in range(0, len(cuts), 64):
        part = list(zip(cuts[at : at + 64].tolist(), ends[at : at + 64].tolist()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([kind] * len(part)),
                pa.array([int(shard[a]) for a, _ in part], pa.int64()),
                pa.array([b - a for a, b in part], pa.int64()),
                pa.array([b"".join(c[a:b].tobytes() for c in columns) for a, b in part], pa.binary()),
            ],
            names=names,
        )


def _unpack(blocks, *kinds) -> list[np.ndarray]:
    """The columns of packed rows ``(n, block)``, one after the other."""
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for n, block in blocks:
        at = 0
        for k, kind in enumerate(kinds):
            out[k].append(np.frombuffer(block, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(o) if o else np.zeros(0, kind) for o, kind in zip(out, kinds)]


def _rows(table: pa.Table):
    return zip(table.column("n").to_pylist(), table.column("block").to_pylist())


def _narrow(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the least bytes that hold them."""
    return values.astype(np.min_scalar_type(int(values.max()) if values.size else 0))


_PACKED = "kind string, shard long, n long, block binary"


def _token_slices(batches, column: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(token hashes, tokens of each document): words and the end of each text, in pieces of ``most`` words or so."""
    held, sizes, n = [], [], 0
    for batch in batches:
        for hashes, per_doc in word_hashes(batch.column(column)):
            at = np.cumsum(per_doc)
            held.append(np.insert(hashes, at, END))
            sizes.append(per_doc + 1)
            n += len(held[-1])
            if n >= most:
                yield np.concatenate(held), np.concatenate(sizes)
                held, sizes, n = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(sizes)


def _hash_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of the hash, so that the shards in order are sorted."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _count_words(shards: int):
    def of(batches):
        for tokens, _ in _token_slices(batches, 0, FLUSH):
            keys, counts = np.unique(tokens, return_counts=True)
            yield from _blocks(_hash_shard(keys, shards), keys, counts.astype(np.uint32))

    return frugal(of)


def _write_words(folder: str):
    def of(key, table):
        shard = key[0].as_py()
        keys, counts = _unpack(_rows(table), np.uint64, np.uint32)
        keys, counts = _merge(keys, counts.astype(np.int64))
        _save(f"{folder}/vocabulary-{shard}.npy", keys)
        _save(f"{folder}/vocabularycount-{shard}.npy", _narrow(counts))
        return pa.table({"shard": [shard], "n": [len(keys)], "total": [int(counts.sum())]})

    return of


def ngram_hash(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each n-gram of ids; its ids stand in as many columns."""
    value = np.full(len(columns[0]), len(columns), np.uint64)
    for ids in columns:
        value = mix(value * _ODD + ids.astype(np.uint64))
    return value


def ngrams(ids: np.ndarray, sizes: np.ndarray, order: int, start: int) -> list[np.ndarray]:
    """The columns of the n-gram that ends in each token; before a text stand start marks."""
    before = order - 1
    padded = np.full(len(ids) + before * len(sizes), start, ids.dtype)
    at = np.arange(len(ids)) + before * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    padded[at] = ids
    return [padded[at - before + k] for k in range(order)]


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts them, where each distinct one starts in it)."""
    order = np.argsort(hashes, kind="stable")
    held = hashes[order]
    first = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1]))) if len(held) else np.zeros(0, np.int64)
    return order, first


def _count_ngrams(words: Words, order: int, shards: int):
    def of(batches):
        for tokens, sizes in _token_slices(batches, 0, FLUSH):
            ids, _ = words.look_up(tokens)
            columns = ngrams(ids, sizes, order, words.size)
            hashes = ngram_hash(columns)
            place, first = _distinct(hashes)
            counts = np.diff(np.append(first, len(hashes))).astype(np.uint32)
            one = place[first]
            yield from _blocks(hashes[one] % np.uint64(shards), *[c[one] for c in columns], counts, kind=f"ngram{order}")

    return frugal(of)


def _write_ngrams(folder: str, order: int, shard: int, shards: int, table: pa.Table, kind: np.dtype) -> Iterator[pa.RecordBatch]:
    """Write a shard of n-grams; what they add to their contexts and to the lower order."""
    *columns, counts = _unpack(_rows(table), *[kind] * order, np.uint32)
    hashes = ngram_hash(columns)
    place, first = _distinct(hashes)
    counts = np.add.reduceat(counts[place].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    one = place[first]
    hashes, columns = hashes[one], [c[one] for c in columns]
    del place, one
    _save(f"{folder}/ngram{order}-{shard}.npy", hashes)
    _save(f"{folder}/ngram{order}count-{shard}.npy", _narrow(counts))
    few = np.append(np.bincount(np.minimum(counts, 5), minlength=6), counts.sum()).astype(np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array([f"stats{order}"]), pa.array([shard], pa.int64()), pa.array([1], pa.int64()), pa.array([few.tobytes()], pa.binary())],
        names=["kind", "shard", "n", "block"],
    )
    if order == 1 or not len(counts):
        return
    context = ngram_hash(columns[:-1])
    place, first = _distinct(context)
    sums = [np.add.reduceat((hit)[place], first, dtype=np.uint32) for hit in (counts == 1, counts == 2, counts > 2)]
    total = np.add.reduceat(counts[place], first).astype(np.uint64)
    own = context[place[first]]
    yield from _blocks(own % np.uint64(shards), own, *sums, total, kind=f"context{order}")
    lower = ngram_hash(columns[1:])
    place, first = _distinct(lower)
    one = place[first]
    n = np.diff(np.append(first, len(lower))).astype(np.uint32)
    yield from _blocks(lower[one] % np.uint64(shards), *[c[one] for c in columns[1:]], n, kind=f"ngram{order - 1}")


def _write_contexts(folder: str, order: int, shard: int, table: pa.Table) -> None:
    """Three numbers of each context, of n-grams seen once, twice and more often, and the sum of their counts."""
    keys, *sums = _unpack(_rows(table), np.uint64, np.uint32, np.uint32, np.uint32, np.uint64)
    place, first = _distinct(keys)
    dense = np.empty((len(first), 4), np.uint64)
    for k, column in enumerate(sums):
        dense[:, k] = np.add.reduceat(column[place].astype(np.uint64), first) if len(first) else 0
    _save(f"{folder}/context{order}-{shard}.npy", keys[place[first]])
    _save(f"{folder}/context{order}sums-{shard}.npy", _narrow(dense))


def _write(folder: str, order: int, shards: int, kind: np.dtype):
    """Writes a shard of whatever kind and hands on what is left to write and the counts of counts."""

    def of(key, table):
        what, shard = key[0].as_py(), key[1].as_py()
        out = []
        if what.startswith("ngram"):
            out = list(_write_ngrams(folder, int(what[5:]), shard, shards, table, kind))
        elif what.startswith("context"):
            _write_contexts(folder, int(what[7:]), shard, table)
        else:
            return table
        return pa.Table.from_batches(out) if out else table.slice(0, 0)

    return of


@lru_cache(maxsize=MAPPED)
def _mapped(path: str) -> np.ndarray | None:
    return np.load(path, mmap_mode="r") if os.path.exists(path) else None


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of its own) for every shard that occurs."""
    order = np.argsort(shard, kind="stable")
    held = shard[order]
    cuts = np.flatnonzero(held[1:] != held[:-1]) + 1
    for own in np.split(order, cuts) if len(held) else []:
        yield int(shard[own[0]]), own


@dataclass(frozen=True)
class Words:
    """The vocabulary: sorted hashes in ``shards`` ranges, whose first ids are in ``base.npy``; ``size + 1`` is an unknown word's id."""

    folder: str
    shards: int
    size: int

    @property
    def kind(self) -> np.dtype:
        return np.dtype(np.uint32 if self.size + 2 < 1 << 32 else np.uint64)

    def look_up(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id and count of each token)."""
        some, back = np.unique(tokens, return_inverse=True)
        ids, counts = np.full(len(some), self.size + 1, self.kind), np.zeros(len(some), np.int64)
        base = _mapped(f"{self.folder}/base.npy")
        for s, own in _by_shard(_hash_shard(some, self.shards)):
            keys = _mapped(f"{self.folder}/vocabulary-{s}.npy")
            if keys is None or not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, some[own]), len(keys) - 1)
            hit = keys[at] == some[own]
            ids[own[hit]] = at[hit] + base[s]
            counts[own[hit]] = _mapped(f"{self.folder}/vocabularycount-{s}.npy")[at[hit]]
        return ids[back], counts[back]


def discounts(few: np.ndarray) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many things are seen once to four times; 0.5, 1, 1.5 where that can't tell."""
    n = few[:5].astype(float)
    if n[1] <= 0 or n[2] <= 0:
        return 0.5, 1.0, 1.5
    y = n[1] / (n[1] + 2 * n[2])
    found = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] > 0 else k / 2 for k in (1, 2, 3)]
    return tuple(min(max(d, 0.0), float(k)) for k, d in zip((1, 2, 3), found))


@dataclass(frozen=True)
class Model:
    """``discounts``: three for each order, the lowest first; ``single``: what the empty context has, as other contexts in their files."""

    words: Words
    order: int
    shards: int
    tokens: int
    discounts: tuple[tuple[float, float, float], ...]
    single: tuple[int, int, int, int]

    def _find(self, name: str, values: str, hashes: np.ndarray, width: int = 1) -> np.ndarray:
        """What the files hold for each of some distinct hashes; 0 where there is nothing."""
        out = np.zeros((len(hashes), width), np.int64)
        for s, own in _by_shard(hashes % np.uint64(self.shards)):
            keys = _mapped(f"{self.words.folder}/{name}-{s}.npy")
            if keys is None or not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, hashes[own]), len(keys) - 1)
            hit = keys[at] == hashes[own]
            out[own[hit]] = _mapped(f"{self.words.folder}/{values}-{s}.npy")[at[hit]].reshape(-1, width)
        return out

    def log10(self, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, log10 add-one unigram probability, log10 model probability) of every token."""
        ids, counts = self.words.look_up(tokens)
        size = self.words.size
        base = np.log10((counts + 1) / (self.tokens + size + 1))
        columns = ngrams(ids, sizes, self.order, size)
        p = np.full(len(ids), 1.0 / (size + 1))
        for k in range(1, self.order + 1):
            own = columns[self.order - k :]
            some, back = np.unique(ngram_hash(own), return_inverse=True)
            seen = self._find(f"ngram{k}", f"ngram{k}count", some)[back, 0]
            if k == 1:
                sums = np.broadcast_to(np.array(self.single, np.int64), (len(ids), 4))
            else:
                some, back = np.unique(ngram_hash(own[:-1]), return_inverse=True)
                sums = self._find(f"context{k}", f"context{k}sums", some, 4)[back]
            off = np.array(self.discounts[k - 1])
            total = sums[:, 3]
            high = np.maximum(seen - np.append(0.0, off)[np.minimum(seen, 3)], 0)
            p = np.where(total > 0, (high + (sums[:, :3] @ off) * p) / np.maximum(total, 1), p)
        return counts, base, np.log10(p)


def train(docs: DataFrame, *, text: str = "text", order: int = ORDER) -> Model:
    """Count the model over all rows of ``docs``."""
    spark = docs.sparkSession
    folder = f"{mounted(shared_dir(spark))}/kn-{uuid.uuid4().hex}"
    os.makedirs(folder)
    size = docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    # a word takes six bytes or so, and a word in ten is new to its task
    word_shards, shards = max(4, math.ceil(size / 60 / SHARD)), max(4, math.ceil(size / 9 / SHARD))
    found = (
        docs.select(text)
        .mapInArrow(_count_words(word_shards), _PACKED)
        .groupBy("shard")
        .applyInArrow(_write_words(folder), "shard long, n long, total long")
        .collect()
    )
    sizes = np.zeros(word_shards, np.int64)
    for row in found:
        sizes[row["shard"]] = row["n"]
    _save(f"{folder}/base.npy", np.concatenate(([0], np.cumsum(sizes))))
    words = Words(folder, word_shards, int(sizes.sum()))
    packed = docs.select(text).mapInArrow(_count_ngrams(words, order, shards), _PACKED)
    for _ in range(order):
        packed = packed.groupBy("kind", "shard").applyInArrow(_write(folder, order, shards, words.kind), _PACKED)
    few = {k: np.zeros(7, np.int64) for k in range(1, order + 1)}
    # the last contexts are written with the words, by the same step
    for row in packed.where(F.col("kind").startswith("stats")).collect():
        few[int(row["kind"][5:])] += np.frombuffer(row["block"], np.int64)
    one = few[1]
    model = Model(
        words, order, shards, sum(r["total"] for r in found), tuple(discounts(few[k]) for k in range(1, order + 1)),
        (int(one[1]), int(one[2]), int(one[3:6].sum()), int(one[6])),
    )
    with open(f"{folder}/model.json", "w") as out:
        json.dump({"order": order, "tokens": model.tokens, "size": words.size, "discounts": model.discounts}, out)
    return model


def score(docs: DataFrame, model: Model, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of every row: log10 probabilities of its text."""

    def of(batches):
        for batch in batches:
            ids = batch.column(0)
            parts = [[], [], [], []]
            for tokens, sizes in _token_slices([batch], 1, SLICE):
                counts, base, high = model.log10(tokens, sizes)
                first = np.cumsum(sizes) - sizes
                parts[0].append(sizes)
                parts[1].append(np.add.reduceat((counts > 0).astype(np.int64), first))
                parts[2].append(np.add.reduceat(base, first))
                parts[3].append(np.add.reduceat(high, first))
            n, known, base, high = (np.concatenate(p) if p else np.zeros(0) for p in parts)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(high, pa.float64())],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(frugal(of), schema)


def with_perplexity(scored: DataFrame) -> DataFrame:
    """Adds ``perplexity``: 10 to the mean negative log10 probability of a token."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op3_kneser_ney(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those whose crc32 of the id isn't 2 modulo 7."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return with_perplexity(score(docs, model)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        "perplexity",
    )
