"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``2r-1 = 3`` differing bits meet in a variant at most two flips from one and one from the
other, so each fingerprint emits the variants within half the radius, the variants are shuffled, and
what collides is verified. Variants that no pair needs are left out: every fingerprint emits itself
and its 64 single flips; of each pair at distance 3 one fingerprint has even parity, and only that
one emits double flips, and of those only the 992 inside one half of the word, as two of any three
differing bits lie in the same half. That makes 560 variants a fingerprint on average, for 2,081.

Variants travel as packed blocks, dealt by a hash of the variant; equal fingerprints are one node, so copies
cost one row. A bucket can't hold more than 1,057 fingerprints, all within three bits of its
members of at most one flip; a block sends on a spanning forest of its verified links, which keeps
every component and never lists the pairs of a group.

Defined results: a null or wordless text has fingerprint zero, linked like any other; rows that
repeat an id are judged each by its own text; a null id is smaller than any other and comes back as null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, frugal, id_column, restored
from tidemark.llm.components import components, forest
from tidemark.llm.texthash import _LOWER, slices, words

RADIUS = 3
SEED = 42
#: Variants that one shuffled block group holds, about.
BLOCK = 3_000_000
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_PAIRS = np.array(
    [_BITS[i] | _BITS[j] for half in (0, 32) for i in range(half, half + 32) for j in range(i + 1, half + 32)],
    dtype=np.uint64,
)
#: The flips that make the variants, by their number: itself, one flip, two flips in one half.
FLIPS = np.concatenate((np.zeros(1, np.uint64), _BITS, _PAIRS))
NEAR = 65


def _votes(hashes: np.ndarray, first: np.ndarray, n_docs: int, step: int = 1 << 16) -> np.ndarray:
    """How often each bit is set in each document's hashes; ``first``: its first hash."""
    votes = np.zeros((n_docs, 64), np.int64)
    for at in range(0, len(hashes), step):
        part = np.ascontiguousarray(hashes[at : at + step])
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        low = int(np.searchsorted(first, at, "right")) - 1
        high = int(np.searchsorted(first, at + len(part), "left"))
        cuts = np.maximum(first[low:high], at) - at
        own = np.arange(low, high)
        full = np.diff(np.append(cuts, len(part))) > 0
        votes[own[full]] += np.add.reduceat(bits, cuts[full], axis=0, dtype=np.int64)
    return votes


def fingerprints(texts: pa.Array, shingle: int) -> np.ndarray:
    """The 64-bit SimHash of each text of the column."""
    out = []
    for raw, off in slices(texts):
        starts, ends, per_doc = words(raw, off)
        n_docs = len(per_doc)
        size = ends - starts
        # the words one after the other, a space between
        place = np.concatenate(([0], np.cumsum(size + 1)))
        flat = np.full(int(place[-1]), 32, np.uint8)
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        flat[np.repeat(place[:-1], size) + within] = _LOWER[raw[np.repeat(starts, size) + within]]
        # a document of n words has max(n - shingle + 1, 1) shingles, or none
        n_sh = np.where(per_doc > 0, np.maximum(per_doc - shingle + 1, 1), 0)
        word0 = np.cumsum(per_doc) - per_doc
        first = np.cumsum(n_sh) - n_sh
        total = int(n_sh.sum())
        begin = np.repeat(word0, n_sh) + (np.arange(total) - np.repeat(first, n_sh))
        last = begin + np.repeat(np.minimum(per_doc, shingle), n_sh) - 1
        data, hash_one = flat.tobytes(), xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (hash_one(data[a:b], SEED) for a, b in zip(place[begin].tolist(), (place[last] + size[last]).tolist())),
            dtype=np.uint64,
            count=total,
        ) if total else np.zeros(0, np.uint64)
        some = n_sh > 0
        votes = np.zeros((n_docs, 64), np.int64)
        if total:
            votes[some] = _votes(hashes, first[some], int(some.sum()))
        set_bits = votes * 2 > n_sh[:, None]
        out.append((set_bits * _BITS[None, :]).sum(axis=1, dtype=np.uint64))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def simhash(docs: DataFrame, *, shingle: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``id, fp``: the fingerprint of every row's text as a signed long."""

    def of(batches):
        for batch in batches:
            fp = fingerprints(batch.column(1), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["id", "fp"])

    return docs.select(id_column(docs, doc_id).alias("id"), F.col(text)).mapInArrow(frugal(of), "id long, fp long")


def _emit(shards: int):
    """Variants of every fingerprint, packed by shard."""

    def of(batches):
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(whole), 4096):
                fp = whole[at : at + 4096]
                even = fp[np.bitwise_count(fp) % 2 == 0]
                near = (fp[:, None] ^ FLIPS[None, :NEAR]).ravel()
                far = (even[:, None] ^ FLIPS[None, NEAR:]).ravel()
                variant = np.concatenate((near, far))
                flip = np.concatenate(
                    (np.tile(np.arange(NEAR), len(fp)), np.tile(np.arange(NEAR, len(FLIPS)), len(even)))
                ).astype(np.uint16)
                shard = shard_of(variant, shards)
                order = np.argsort(shard, kind="stable")
                variant, flip = variant[order], flip[order]
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                rows = [
                    (s, variant[a:b].tobytes() + flip[a:b].tobytes())
                    for s, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                    if b > a
                ]
                for k in range(0, len(rows), 64):
                    part = rows[k : k + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.binary())],
                        names=["shard", "block"],
                    )

    return of


def shard_of(variant: np.ndarray, shards: int) -> np.ndarray:
    top = (variant * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return (top % np.uint64(shards)).astype(np.uint16 if shards < 65536 else np.uint32)


def _meet(table: pa.Table) -> pa.Table:
    """The verified links of one shard, as a spanning forest."""
    variants, flips = [], []
    for block in table.column("block").to_pylist():
        n = len(block) // 10
        variants.append(np.frombuffer(block, np.uint64, n))
        flips.append(np.frombuffer(block, np.uint16, n, n * 8))
    variant, flip = np.concatenate(variants), np.concatenate(flips)
    del variants, flips
    order = np.argsort(variant)
    variant, flip = variant[order], flip[order]
    same = variant[1:] == variant[:-1]
    many = np.zeros(len(variant), bool)
    many[1:] |= same
    many[:-1] |= same
    variant, flip = variant[many], flip[many]
    fp = variant ^ FLIPS[flip]
    # a bucket's hub is one of its members of at most one flip: all others are within three bits of it
    order = np.lexsort((fp, flip >= NEAR, variant))
    variant, flip, fp = variant[order], flip[order], fp[order]
    first = np.concatenate(([True], variant[1:] != variant[:-1])) if len(variant) else np.zeros(0, bool)
    hub = np.flatnonzero(first)[np.cumsum(first) - 1] if len(variant) else np.zeros(0, np.int64)
    ok = (flip[hub] < NEAR) & (fp != fp[hub])
    a, b = fp[ok], fp[hub[ok]]
    true = np.bitwise_count(a ^ b) <= RADIUS
    node, root = forest(a[true].view(np.int64), b[true].view(np.int64))
    return pa.table({"a": pa.array(node, pa.int64()), "b": pa.array(root, pa.int64())})


def ball_links(fps: DataFrame, n: int) -> DataFrame:
    """``a, b``: links that connect whatever lies within three bits, of the ``n`` distinct ``fp`` of ``fps``."""
    shards = max(1, math.ceil(n * 560 / BLOCK))
    blocks = fps.select("fp").mapInArrow(frugal(_emit(shards)), "shard int, block binary")
    return blocks.groupBy("shard").applyInArrow(_meet, "a long, b long")


def near_duplicates(docs: DataFrame, *, shingle: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``id, fp, component`` for every row: the component is the smallest id that links of three bits or fewer reach."""
    hashed = cut(simhash(docs, shingle=shingle, text=text, doc_id=doc_id))
    nodes = cut(hashed.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(ball_links(nodes, nodes.count()))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    classes = rooted.join(least, "root").select("fp", "component")
    return hashed.join(classes, "fp").select("id", "fp", "component")


def keep_first(docs: DataFrame, *, shingle: int = 5) -> DataFrame:
    """The documents of which no smaller ``doc_id`` is a near-duplicate; all columns stay as they are.

    Rows that repeat the id of a kept document are that document and stay.
    """
    gone = (
        near_duplicates(docs, shingle=shingle)
        .groupBy("id")
        .agg(F.min("component").alias("least"))
        .where("least < id")
        .select(F.col("id").alias("__td_gone"))
    )
    return docs.join(gone, id_column(docs) == F.col("__td_gone"), "left_anti")


def op5_simhash_ball(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return found.select(
        restored(F.col("id")).alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        restored(F.col("component")).alias("component_id"),
    )
