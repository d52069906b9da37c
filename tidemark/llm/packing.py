"""Best-fit packing of tokenised documents, certified by lower bounds.

Documents become ids of a public vocabulary and one separator; only those over the capacity are cut, into full pieces
behind a first piece that may be shorter. Pieces are dealt evenly over partitions by a hash, each partition packs its own by
best-fit decreasing, and dual feasible functions bound the bins that it must use. Where the bound
is missed (and for the emptiest bin of a partition that meets it) the badly filled bins give back their pieces; these
are dealt anew and packed again, until nothing is given back, a single partition has packed all that was,
or a round doesn't gain: it neither saves a sequence nor leaves fewer pieces to give back. No number of rounds ends it.

Defined results: a null text is empty and is the separator alone; rows that repeat an id are packed
each for itself; a null id is packed like any other; the string of an added token in a text is that token, as the library has it.
"""

from __future__ import annotations

import itertools
import json
import math
import os
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, frugal
from tidemark.llm.pretokens import Memo

CAPACITY = 2048
#: Pieces that one partition packs, about.
PART = 30_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Texts to ids as the library encodes them; ``added``: the strings that are tokens of their own wherever they stand."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.added = [t["content"] for t in json.load(file).get("added_tokens", [])]
        self.memo = Memo(self._pieces)

    def _pieces(self, pieces: list[bytes]) -> list[list[int]]:
        texts = [p.decode() for p in pieces]
        return [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_column(self, texts: pa.Array):
        """The ids of each text; one that names an added token goes to the library as a whole."""
        texts = texts.cast(pa.large_string())
        named = np.zeros(len(texts), bool)
        for token in self.added:
            named |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(named), pa.scalar(None, pa.large_string()), texts) if named.any() else texts
        for at, coded in enumerate(self.memo.encode_column(plain)):
            if named[at]:
                coded = np.array(self.whole.encode(texts[at].as_py(), add_special_tokens=False).ids, np.uint32)
            yield coded


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: one, or full ones behind a first that takes the rest."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(
    docs: DataFrame, *, path: str | None = None, capacity: int = CAPACITY, separator: int = 0,
    text: str = "text", doc_id: str = "doc_id", ids: bool = False,
) -> DataFrame:
    """The pieces of every document: ``doc_id, piece, start, length, ids_crc32``, and the ``ids`` if asked."""
    path = path or vocabulary()

    def of(batches):
        encoder = _encoder(path)
        end = np.array([separator], np.uint32)
        for batch in batches:
            rows, whole = [], []
            keys = batch.column(0).to_pylist()
            for key, coded in zip(keys, encoder.encode_column(batch.column(1))):
                coded = np.concatenate((coded, end)).astype("<u4")
                for k, (at, size) in enumerate(cuts(len(coded), capacity)):
                    part = coded[at : at + size]
                    rows.append((key, k, at, size, zlib.crc32(part.tobytes())))
                    if ids:
                        whole.append(part)
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ids:
                arrays.append(pa.array(whole, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = PIECES + (", ids array<long>" if ids else "")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(frugal(of), schema)


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs, by two families of dual feasible functions.

    The first counts sizes over ``capacity - k`` as a whole bin and drops those under ``k``; the second
    rounds sizes to k-ths of the bin.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    n_from = np.concatenate((np.cumsum(count[::-1])[::-1], [0]))
    sum_from = np.concatenate((np.cumsum((count * size)[::-1])[::-1], [0]))
    k = np.arange(0, capacity // 2 + 1)
    whole = n_from[capacity - k + 1]
    middle = sum_from[k] - sum_from[capacity - k + 1]
    best = max(best, int((whole + -(-middle // capacity)).max()))
    for k in range(1, 64):
        scaled = (k + 1) * size
        # in units of 1 / (k * capacity)
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin, offset) of each size and the room left in each bin; sizes fall, ties keep their order.

    Open bins stand by the room they have left, and the set of rooms is one integer's bits, so the best
    fit is the lowest bit from the size on.
    """
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, left = 0, []
    for at in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[at])
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            stack = stacks[room]
            which = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            room, which = capacity, len(left)
            left.append(capacity)
        bins[at], offsets[at] = which, capacity - room
        room -= size
        left[which] = room
        if room:
            stacks[room].append(which)
            rooms |= 1 << room
    return bins, offsets, left


def _pack(capacity: int, turn: int):
    """Packs one partition; ``open``: its bin gives its pieces back if there is another round."""

    def of(key, table):
        part = key[0].as_py()
        order = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sizes = order.column("length").to_numpy()
        bins, offsets, left = best_fit_decreasing(sizes, capacity)
        room = np.array(left)
        bound = lower_bound(sizes, capacity)
        gives = room > capacity // 100 if len(left) > bound else room == max(room.max(), 1)
        numbers = (turn << 54) + (part << 24) + bins
        drop = ["__td_part"]
        return (
            order.drop_columns(drop)
            .append_column("sequence_id", pa.array(numbers, pa.int64()))
            .append_column("offset", pa.array(offsets, pa.int64()))
            .append_column("__td_open", pa.array(gives[bins]))
        )

    return of


def pack(rows: DataFrame, *, capacity: int = CAPACITY, part: int = PART, rounds: int | None = None) -> DataFrame:
    """``rows`` (with ``doc_id, piece, length, ids_crc32`` and any others) and their ``sequence_id`` and ``offset``.

    ``rounds`` ends the exchange early, if given.
    """
    columns = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    rows = cut(rows.select(*columns))
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    out_schema += ", sequence_id long, offset long, __td_open boolean"
    # a piece that fills a sequence needs no packing
    done = [
        rows.where(F.col("length") >= capacity).select(
            *columns,
            (F.lit(1 << 60) + F.monotonically_increasing_id()).alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"),
        )
    ]
    pool = rows.where(F.col("length") < capacity)
    n, before, kept = pool.count(), None, None
    for turn in itertools.count():
        parts = max(1, math.ceil(n / part))
        dealt = F.pmod(F.xxhash64(F.lit(turn), "doc_id", "piece", "ids_crc32"), F.lit(parts)).alias("__td_part")
        packed = cut(
            pool.select(*columns, dealt).groupBy("__td_part").applyInArrow(_pack(capacity, turn), out_schema)
        )
        bins = packed.agg(F.count_distinct("sequence_id")).first()[0]
        if before is not None and bins > before:
            done.append(kept.drop("__td_open"))  # no gain: as it was
            break
        pieces_before, n = n, packed.where("__td_open").count()
        gained = before is None or bins < before or n < pieces_before
        if not n or parts == 1 or not gained or turn + 1 == rounds:
            done.append(packed.drop("__td_open"))
            break
        done.append(packed.where(~F.col("__td_open")).drop("__td_open"))
        kept = packed.where("__td_open")
        before = kept.agg(F.count_distinct("sequence_id")).first()[0]
        pool = kept.select(*columns)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def best_fit_packing(docs: DataFrame, *, path: str | None = None, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack(pieces(docs, path=path, capacity=capacity, ids=ids), capacity=capacity)


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
