"""I-Match document fingerprints over randomised lexicons.

Terms (lower-cased words) are counted by hashed bucket, once a document, over all documents; the lexicon is the
buckets whose inverse document frequency lies in the chosen band, that is whose document frequency is between two shares
of all documents. It is kept as a bitmap of ``BUCKETS`` bits, so its size is fixed; a bucket mixes rare terms at a rate
that doesn't depend on the number of documents, far below the band's lower end.

A document's band terms, distinct and sorted, are hashed once for each of ``LEVELS * SUBSETS`` randomised
subsets of the lexicon: the subsets of level v keep a bucket with probability 4^-v. A dense subset changes with any term; a
sparse one survives an edit that leaves its few terms alone. A document with fewer than ``FEW`` band terms uses all its terms,
one without any the hash of its text. The fingerprint is these hashes (0 where a subset has none of the
document's terms). The likeness of two is, at the densest level where at most ``FULL`` of the subsets are used by either, the share
of equal hashes among the used subsets; equal fingerprints have likeness 1.

The edited copy needs the next document, so documents are range-partitioned by id and sorted; each partition hands its first and
last rows on to settle the borders. Texts are shuffled once, compressed.

Defined results: a null text is empty; a null id stands before all others; rows that repeat an id follow each other by the
hash of their text; the single row of a table is its own next; an empty table gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, frugal, id_column, restored
from tidemark.llm.texthash import mix, word_hashes

BUCKETS = 1 << 22
#: The band, as shares of all documents.
LOW_SHARE, HIGH_SHARE = 1e-4, 0.2
LEVELS, SUBSETS = 7, 16
FEW = 8
FULL = 0.75
_SALTS = mix(np.arange(1, LEVELS * SUBSETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _document_terms(texts: pa.Array):
    """(sorted distinct term hashes) of each text."""
    for hashes, per_doc in word_hashes(texts):
        for part in np.split(hashes, np.cumsum(per_doc)[:-1]):
            yield np.unique(part)


def _frequencies(batches):
    """Document frequency of every bucket that occurs in a partition."""
    seen = np.zeros(BUCKETS, np.int32)
    for batch in batches:
        for hashes, per_doc in word_hashes(batch.column(0)):
            doc = np.repeat(np.arange(len(per_doc), dtype=np.uint64), per_doc)
            pairs = np.unique((doc << np.uint64(22)) | (hashes % np.uint64(BUCKETS)))
            seen += np.bincount((pairs & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS).astype(np.int32)
    some = np.flatnonzero(seen)
    for at in range(0, len(some), 50_000):
        part = some[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(seen[part])], names=["bucket", "df"])


def lexicon(docs: DataFrame, *, text: str = "text", low: float = LOW_SHARE, high: float = HIGH_SHARE) -> np.ndarray:
    """The bitmap of the buckets in the band (512 kB), from all documents; a term must be in two at least."""
    total = docs.count()
    words = (
        docs.select(text)
        .mapInArrow(frugal(_frequencies), "bucket int, df int")
        .groupBy("bucket")
        .agg(F.sum("df").alias("df"))
        .where((F.col("df") >= F.lit(max(2.0, low * total))) & (F.col("df") <= F.lit(max(2.0, high * total))))
        .groupBy(F.shiftright("bucket", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, bucket & 63)")).alias("bits"))
        .toArrow()
    )
    bits = np.zeros(BUCKETS // 64, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bits.view(np.uint8)


def fingerprint(terms: np.ndarray, bitmap: np.ndarray, empty: int) -> np.ndarray:
    """The hashes of the subsets, from the sorted distinct term hashes; ``empty`` is the hash of a text without terms."""
    bucket = (terms % np.uint64(BUCKETS)).astype(np.int64)
    held = terms[(bitmap[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 == 1]
    if len(held) < FEW:
        held = terms
    if not len(held):
        return np.full(LEVELS * SUBSETS, max(empty >> 48, 1), np.uint16)
    out = np.zeros(LEVELS * SUBSETS, np.uint16)
    for level in range(LEVELS):
        own = slice(level * SUBSETS, (level + 1) * SUBSETS)
        drawn = mix(held[:, None] ^ _SALTS[None, own])
        # the lowest bits decide whether the subset has the term, the rest identify it
        inside = drawn & np.uint64((1 << (2 * level)) - 1) == 0
        total = (drawn * inside).sum(axis=0, dtype=np.uint64)
        # 16 bits of each hash, never 0 for a subset in use
        marks = np.maximum((total >> np.uint64(48)).astype(np.uint16), 1)
        out[own] = np.where(inside.any(axis=0), marks, 0)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; see the module."""
    if (a == b).all():
        return 1.0
    best = 0.0
    for level in range(LEVELS):
        own = slice(level * SUBSETS, (level + 1) * SUBSETS)
        x, y = a[own], b[own]
        used = (x != 0) | (y != 0)
        if not used.any():
            break
        best = float((x[used] == y[used]).sum()) / int(used.sum())
        if used.sum() <= FULL * SUBSETS:
            break
    return best


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much from the start of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _fingerprints(texts: list[str], bitmap: np.ndarray) -> list[np.ndarray]:
    empty = [int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big") for t in texts]
    return [fingerprint(t, bitmap, e) for t, e in zip(_document_terms(pa.array(texts, pa.large_string())), empty)]


_FIELDS = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = (
    "id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
    "near_edited double, near_next double"
)


def _pairs(rows: list[tuple[int, str]], bitmap: np.ndarray) -> list[tuple]:
    """The results of all rows but the last, each with the row behind it."""
    texts = [t for _, t in rows]
    own = _fingerprints(texts, bitmap)
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    theirs = _fingerprints(changed, bitmap) if changed else []
    return [
        (
            key, len(text), hashlib.sha256(change.encode()).hexdigest(), a.astype(">u2").tobytes(), e.astype(">u2").tobytes(),
            likeness(a, e), likeness(a, b),
        )
        for (key, text), a, b, change, e in zip(rows, own, own[1:], changed, theirs)
    ]


def _chained(bitmap: np.ndarray):
    """Results within a sorted partition, and its first and last rows for the borders (packed text, side 1 and 2)."""

    def of(batches):
        squeeze, open_ = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        part, before, first = None, None, None

        def out(found: list[tuple], border: list[tuple]):
            columns = list(zip(*found)) if found else [[]] * 7
            n = len(found)
            data = {f: list(c) for f, c in zip(_FIELDS, columns)}
            for f in _FIELDS:
                data[f] += [None] * len(border)
            data["id"] = data["id"][:n] + [b[1] for b in border]
            data["side"] = [0] * n + [b[0] for b in border]
            data["part"] = [part] * (n + len(border))
            data["packed"] = [None] * n + [squeeze.compress(b[2].encode()) for b in border]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.binary()]
            names = [*_FIELDS, "side", "part", "packed"]
            return pa.RecordBatch.from_arrays([pa.array(data[k], t) for k, t in zip(names, kinds)], names=names)

        for batch in batches:
            ids, packed = batch.column(0).to_pylist(), batch.column(1)
            part = batch.column(2)[0].as_py() if len(ids) else part
            for at in range(0, len(ids), 256):
                rows = [
                    (i, open_.decompress(p.as_py()).decode())
                    for i, p in zip(ids[at : at + 256], packed[at : at + 256])
                ]
                if first is None:
                    first = rows[0]
                chain = ([before] if before is not None else []) + rows
                before = rows[-1]
                yield out(_pairs(chain, bitmap), [])
        if first is not None:
            yield out([], [(1, *first), (2, *before)])

    return of


def _squeezed(batches):
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [squeeze.compress((t or "").encode()) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(packed, pa.binary()), batch.column(2), batch.column(3)],
            names=["id", "packed", "tie", "salt"],
        )


def neighbours(docs: DataFrame, bitmap: np.ndarray, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every row's fingerprint, edited fingerprint and likenesses, by ascending id."""
    # rows equal in id and text may stand in any order: their places in the input let ranges split them
    keyed = docs.select(id_column(docs, doc_id).alias("id"), F.col(text).alias("t")).select(
        "id", "t", F.xxhash64(F.coalesce("t", F.lit(""))).alias("tie"), F.monotonically_increasing_id().alias("salt")
    )
    packed = keyed.mapInArrow(frugal(_squeezed), "id long, packed binary, tie long, salt long")
    ranged = (
        packed.repartitionByRange("id", "tie", "salt")
        .sortWithinPartitions("id", "tie", "salt")
        .select("id", "packed", F.spark_partition_id().alias("part"))
    )
    found = cut(ranged.mapInArrow(frugal(_chained(bitmap)), f"{_SCHEMA}, side int, part int, packed binary"), "imatch")
    inside = found.where("side = 0").select(*_FIELDS)
    borders = found.where("side > 0")
    # the numbers of the partitions that have rows: as many as partitions
    used = sorted(r["part"] for r in borders.where("side = 1").select("part").collect())
    if not used:
        return inside
    following = docs.sparkSession.createDataFrame(
        list(zip(used, used[1:] + used[:1])), "part int, next_part int"
    )
    heads = borders.where("side = 1").select(F.col("part").alias("next_part"), F.col("packed").alias("next_packed"))
    tails = borders.where("side = 2").select("part", "id", "packed")
    ends = tails.join(following, "part").join(heads, "next_part").select("id", "packed", "next_packed")

    def settle(batches):
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for i, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                pair = [(i, open_.decompress(a).decode()), (i, open_.decompress(b).decode())]
                rows += _pairs(pair, bitmap)
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_FIELDS)

    return inside.unionByName(ends.mapInArrow(frugal(settle), _SCHEMA))


def fingerprints(docs: DataFrame, bitmap: np.ndarray, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, fingerprint`` of every row."""

    def of(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            marks = [x.astype(">u2").tobytes().hex() for x in _fingerprints(texts, bitmap)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(of, "doc_id long, fingerprint string")


def op9_imatch(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited copies, and their likenesses."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = neighbours(docs, lexicon(docs))
    hexed = {c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")}
    return found.withColumns(hexed).select(restored(F.col("id")).alias("doc_id"), *_FIELDS[1:])
