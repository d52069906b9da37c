"""Near-duplicates of a Jaccard similarity, by SimHash and meet-in-the-middle ball hashing.

Radius 3 of one 64-bit fingerprint finds few texts under similarity 0.95, so here a text has several short SimHash
fingerprints (tables), of independent bits over its set of five-word shingles. At similarity s two bits differ with probability
``acos(2s / (1 + s)) / pi`` or less, 0.15 at 0.8, so two similar texts are within ``RADIUS`` = 2 bits in some table all but
surely: the tables are as many as it takes to miss a pair of exactly ``SIMILARITY`` once in ``1 / MISS`` times (sets of under ten
shingles: up to once in 100 times). Fingerprints grow with the logarithm of the number of texts, so that buckets of unlike texts stay small at every size.

1. Each distinct word sequence is a node, so copies cost one row. Nodes are shuffled once a table, by its top bits, and a pair meets
   where these agree: that takes more tables, as ``plan`` counts, but sending the flips of top bits too would move several times the rows.
   A node's variants within half the radius are itself and its single flips of the other bits, made where they meet.
2. In each bucket members are held against the bucket's leaders, drawn anew for each table, by their sizes and 512 more SimHash
   bits; who is near less than two leaders leads too. Of what is near, the ``NEAREST`` to each member of a shard are candidate links.
3. Candidate links are verified by the exact similarity of the two sets, in plain joins that adaptive execution can
   split: first each node's ``NEAREST``, then whatever still joins two components. No link is taken unverified.
4. Whoever led neither and met in a bucket, or was near to more than its candidates, is dealt once more, with the components so far: what lies in
   different ones is met again, now with sixteen times the leaders, until no two members of different components are left unheld. These
   are held by ``LONG_BITS`` too, and all that are near are candidates. No cap drops a candidate.

Defined results: wordless and null texts are one node, of no similarity to others; a text of fewer words than a shingle
is one shingle; rows that repeat an id are judged each by its own text; a null id is smaller than any other; an empty
table gives none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, frugal, id_column, release
from tidemark.llm.components import components
from tidemark.llm.texthash import _ODD, hash_words, mix, slices, words

#: The least similarity of a link, as a fraction.
SIMILARITY = (4, 5)
SHINGLE = 5
RADIUS = 2
MISS = 0.001
#: Allowance for sets of few elements, whose bits differ more often.
SMALL = 1.12
#: Bits that candidates are held against each other by, and how many may differ: 77.6 do at similarity 0.8, give or take 8.1;
#: more in sets of under ``FEW`` elements.
CHECK_BITS, CHECK_NEAR = 512, 106
FEW, CHECK_FEW = 16, 135
#: The bits of the later rounds: 621 differ at similarity 0.8, give or take 23, and some more in small sets; held from ``FEW`` elements on.
LONG_BITS, LONG_NEAR = 4096, 737
#: Leaders in a bucket that a member is near to before it stops leading itself, in the first round, and how many times that in the next.
LEADERS, MORE = 2, 16
#: Links of a node that a shard of the first round makes, and that are verified first; the others are where they still join two components.
NEAREST = 4
#: Variants that one shard holds, that are made and met at once, about; links that are held before repeats among them go.
BLOCK, RANGE, STEP = 10_000_000, 250_000, 3_000_000
_LANE = np.uint64(0x0101010101010101)
_ENTRY = np.dtype([("key", "<u4"), ("size", "<u4"), ("node", "<i8"), ("check", "<u8", CHECK_BITS // 64)])
_ROOTED = np.dtype([*_ENTRY.descr, ("root", "<i8"), ("long", "<u8", LONG_BITS // 64)])


@dataclass(frozen=True)
class Plan:
    """``tables`` fingerprints of ``bits`` bits, dealt by their top ``deal`` bits, in which a pair has to agree."""

    bits: int
    tables: int
    deal: int

    @property
    def words(self) -> int:
        return -(-(self.bits * self.tables + CHECK_BITS) // 64)


def plan(n: int, similarity: tuple[int, int] = SIMILARITY) -> Plan:
    """For ``n`` texts."""
    s = similarity[0] / similarity[1]
    p = SMALL * math.acos(2 * s / (1 + s)) / math.pi
    bits = min(30, max(16, math.ceil(math.log2(n + 1)) + 2))
    deal = max(0, math.ceil(math.log2(max(1.0, n * (bits + 1) / BLOCK))))
    meet = sum(math.comb(bits - deal, k) * p**k * (1 - p) ** (bits - k) for k in range(RADIUS + 1))
    tables = math.ceil(math.log(MISS) / math.log(1 - meet))
    return Plan(bits, tables, deal)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE):
    """(nodes, hash of every distinct shingle, shingles of each document) for each slice of the column, in order; sorted."""
    for raw, off in slices(texts):
        starts, ends, per_doc = words(raw, off)
        hashes = hash_words(raw, starts, ends)
        n_sh = np.where(per_doc > 0, np.maximum(per_doc - shingle + 1, 1), 0)
        word0 = np.cumsum(per_doc) - per_doc
        first = np.cumsum(n_sh) - n_sh
        begin = np.repeat(word0 - first, n_sh) + np.arange(int(n_sh.sum()))
        width = np.repeat(np.minimum(per_doc, shingle), n_sh)
        value = width.astype(np.uint64)
        for j in range(shingle):
            word = hashes[np.minimum(begin + j, len(hashes) - 1)] if len(hashes) else hashes
            value = value * _ODD + np.where(j < width, word, np.uint64(0))
        node = np.zeros(len(per_doc), np.uint64)
        some = per_doc > 0
        if some.any():
            place = (np.arange(len(hashes)) - np.repeat(word0, per_doc)).astype(np.uint64)
            node[some] = mix(np.add.reduceat(mix(hashes + mix(place * _ODD + np.uint64(1))), word0[some]))
        doc = np.repeat(np.arange(len(per_doc)), n_sh)
        value = mix(value)
        order = np.lexsort((value, doc))
        value = value[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        yield node, value[new], np.bincount(doc[new], minlength=len(per_doc))


def _votes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set between each ``first`` and the next; eight counters to a word, of 255 at most."""
    size = np.diff(np.append(first, len(hashes)))
    parts = -(-size // 255)
    owner = np.cumsum(parts) - parts
    at = np.repeat(first, parts) + 255 * (np.arange(int(parts.sum())) - np.repeat(owner, parts))
    out = np.empty((len(first), 8, 8), np.int64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANE, at).view(np.uint8).reshape(-1, 8)
        out[:, :, k] = np.add.reduceat(lanes, owner, axis=0, dtype=np.int64)
    return out.reshape(len(first), 64)


def sketches(hashes: np.ndarray, n_sh: np.ndarray, n_words: int) -> np.ndarray:
    """SimHash bits of each set that isn't empty, as ``n_words`` words of 64."""
    size = n_sh[n_sh > 0]
    first = np.cumsum(size) - size
    out = np.empty((len(size), n_words), np.uint64)
    if not len(size):
        return out
    even = np.arange(64) % 2 == 0  # where a set is divided evenly, the bit's place decides
    for w, salt in enumerate(mix(np.arange(1, n_words + 1, dtype=np.uint64))):
        votes = _votes(mix(hashes ^ salt), first) * 2
        on = (votes > size[:, None]) | ((votes == size[:, None]) & even)
        out[:, w] = np.packbits(on, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _sketch(shingle: int, n_words: int):
    def of(batches):
        for batch in batches:
            at = 0
            for node, hashes, n_sh in shingle_sets(batch.column(1), shingle):
                blobs = np.full(len(node), None, object)
                blobs[n_sh > 0] = [k.tobytes() for k in sketches(hashes, n_sh, n_words)]
                own = [batch.column(0).slice(at, len(node)), pa.array(node.view(np.int64)), pa.array(n_sh), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(own, names=["id", "node", "size", "sketch"])
                at += len(node)

    return of


def _deal(how: Plan, rooted: bool = False):
    """Every node once a table, packed by shard; ``rooted``: with its component's root and the long check."""

    few = 1024 if rooted else 4096

    def of(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, few):
                part = batch.slice(at, few)
                raw = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                bits = np.unpackbits(raw, axis=1, bitorder="little")
                own = np.empty(part.num_rows, _ROOTED if rooted else _ENTRY)
                if rooted:
                    own["root"] = part.column(3).to_numpy(zero_copy_only=False)
                    own["long"] = np.frombuffer(b"".join(part.column(4).to_pylist()), "<u8").reshape(part.num_rows, -1)
                own["node"], own["size"] = (part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                own["check"] = np.ascontiguousarray(raw[:, -(CHECK_BITS // 8) :]).view("<u8")
                weight = np.uint32(1) << np.arange(how.bits, dtype=np.uint32)
                rows = []
                for table in range(how.tables):
                    own["key"] = bits[:, table * how.bits : (table + 1) * how.bits] @ weight
                    top = (own["key"] >> np.uint32(how.bits - how.deal)).astype(np.int64)
                    order = np.argsort(top, kind="stable")
                    sent, top = own[order], top[order]
                    cuts = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
                    shard = (table << how.deal) + top[cuts]
                    rows += zip(shard.tolist(), (p.tobytes() for p in np.split(sent, cuts[1:])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                    names=["shard", "block"],
                )

    return of


def _variants(key: np.ndarray, low_bits: int, fine: int):
    """(variants, their entries' places) of each of the ``1 << fine`` ranges: the keys with all single flips of ``low_bits``, whole buckets at a time."""
    low = low_bits - fine
    own = (key >> np.uint32(low)) & np.uint32((1 << fine) - 1)
    order = np.argsort(own, kind="stable").astype(np.uint32)
    cuts = np.searchsorted(own[order], np.arange((1 << fine) + 1))
    flips = np.concatenate((np.zeros(1, np.uint32), np.uint32(1) << np.arange(low, dtype=np.uint32)))
    for part in range(1 << fine):
        inside = order[cuts[part] : cuts[part + 1]]
        variant, who = [(key[inside][:, None] ^ flips[None, :]).ravel()], [np.repeat(inside, len(flips))]
        for f in range(fine):  # from the ranges that are one flip away
            other = part ^ (1 << f)
            who.append(order[cuts[other] : cuts[other + 1]])
            variant.append(key[who[-1]] ^ np.uint32(1 << (low + f)))
        yield np.concatenate(variant), np.concatenate(who)


def _apart(check: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """In how many bits the checks of ``a`` and ``b`` differ; few at a time, as a check is many bytes."""
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), step):
        one = slice(at, at + step)
        out[one] = np.bitwise_count(check[a[one]] ^ check[b[one]]).sum(axis=1, dtype=np.int64)
    return out


def _mixed(variant: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Which members stand in a bucket of more than one root; buckets one after the other."""
    if not len(variant):
        return np.zeros(0, bool)
    first = np.flatnonzero(np.concatenate(([True], variant[1:] != variant[:-1])))
    mixed = np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first)
    return np.repeat(mixed, np.diff(np.append(first, len(variant))))


def lead(variant: np.ndarray, who: np.ndarray, entries: np.ndarray, table: int = 0, leaders: int | None = None):
    """(links of members to leaders, nodes that aren't held against each other) of whole buckets.

    Bucket by bucket the first by a hash of node and ``table`` leads and is linked to what is near; then the next of those that
    aren't linked to ``leaders`` yet. Who is linked to as many goes on being held against new leaders. Entries with a root are
    held against those of other roots only, by the long check too.
    """
    leaders = leaders or LEADERS
    rooted = "root" in entries.dtype.names
    node, check, size = entries["node"], entries["check"], entries["size"].astype(np.int64)
    root = entries["root"] if rooted else node
    up, down = SIMILARITY
    draw = mix(node.view(np.uint64) ^ mix(np.full(1, table, np.uint64)))[who] >> np.uint64(32)
    draw |= variant.astype(np.uint64) << np.uint64(32)
    order = np.argsort(draw)
    del draw
    held = variant[order]
    if rooted:
        alone = ~_mixed(held, root[who[order]])
    else:
        alone = np.ones(len(held), bool)
        alone[1:] &= held[1:] != held[:-1]
        alone[:-1] &= held[1:] != held[:-1]
    pool, links = order[~alone], []
    del order, held, alone
    met, hits = pool, np.zeros(len(variant), np.int32)
    while len(pool):
        v = variant[pool]
        free = np.flatnonzero(hits[pool] < leaders)
        if not len(free):
            break
        free = free[np.concatenate(([True], v[free[1:]] != v[free[:-1]]))]
        place = np.minimum(np.searchsorted(v[free], v), len(free) - 1)
        led = v[free][place] == v  # buckets whose members all have their leaders are through
        led[free] = False
        heads = pool[free]
        asks = np.flatnonzero(led)
        a, b = who[pool[asks]], who[heads[place[asks]]]
        if rooted:
            other = root[a] != root[b]
            asks, a, b = asks[other], a[other], b[other]
        apart = _apart(check, a, b)
        less, more = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        near = (apart <= np.where(less < FEW, CHECK_FEW, CHECK_NEAR)) & (less * down >= more * up)
        if rooted:
            asked = np.flatnonzero(near & (less >= FEW))
            near[asked[_apart(entries["long"], a[asked], b[asked], 1 << 13) > LONG_NEAR]] = False
        links.append((node[a[near]], node[b[near]], apart[near]))
        hits[pool[asks[near]]] += 1
        pool = pool[led]
    unheld = met[hits[met] >= leaders]
    unheld = unheld[_mixed(variant[unheld], root[who[unheld]])]
    return [np.concatenate(x) for x in zip(*links)] if links else [], np.unique(node[who[unheld]])


def _meet(low_bits: int, deal: int = 0, leaders: int | None = None, rooted: bool = False, marks: bool = False):
    """Candidate links ``a, b, apart`` of a shard, range by range of variants.

    ``marks``: also a row ``a, a, -1`` for every node that wasn't held against all others, or has a link that isn't among the ``NEAREST``, which
    are all that is made of entries without a root. A bucket is met as a whole, however large its shard, so that unlike texts aren't marked.
    """

    def of(table: pa.Table) -> pa.Table:
        entries = np.frombuffer(b"".join(table.column("block").to_pylist()), _ROOTED if rooted else _ENTRY)
        salt = table.column("shard")[0].as_py() >> deal
        fine = min(low_bits, 10, max(0, math.ceil(math.log2(max(1, len(entries) * (low_bits + 1) / RANGE)))))
        found, unheld = [], []
        for variant, who in _variants(np.ascontiguousarray(entries["key"]), low_bits, fine):
            links, left = lead(variant, who, entries, salt, leaders)
            unheld.append(left)
            if links:
                found.append(_nearest(*links))
            if sum(len(x[0]) for x in found[1:]) > STEP:
                found = [_nearest(*(np.concatenate(x) for x in zip(*found)))]
        a, b, apart = _nearest(*(np.concatenate(x) for x in zip(*found))) if found else (np.zeros(0, np.int64),) * 3
        if marks:
            if not rooted:
                made = _place(a, apart) < NEAREST
                unheld += [a[~made], b[~made]]
                a, b, apart = a[made], b[made], apart[made]
            left = np.unique(np.concatenate(unheld))
            a, b, apart = np.concatenate((a, left)), np.concatenate((b, left)), np.concatenate((apart, np.full(len(left), -1)))
        out = pa.table({"a": pa.array(a), "b": pa.array(b), "apart": pa.array(apart.astype(np.int32))})
        del entries, found
        release()
        return out

    return of


def _nearest(a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, ``a`` the larger."""
    a, b = np.maximum(a, b), np.minimum(a, b)
    order = np.lexsort((apart, b, a))
    a, b, apart = a[order], b[order], apart[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    new &= a != b
    return a[new], b[new], apart[new]


def _place(a: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """The place of each link among those of its ``a``, the nearest first; ``a`` is sorted."""
    first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
    out = np.empty(len(a), np.int64)
    out[np.lexsort((apart, a))] = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
    return out


def _sets(shingle: int):
    """``node, shingles``: the distinct shingles of every text that has any."""

    def of(batches):
        for batch in batches:
            for node, hashes, n_sh in shingle_sets(batch.column(1), shingle):
                some = n_sh > 0
                off = np.concatenate(([0], np.cumsum(n_sh[some]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node[some].view(np.int64)), lists], names=["node", "shingles"])

    return of


def verified(links: DataFrame, sets: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Those of ``a, b`` whose sets have the similarity, exactly."""
    up, down = similarity
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    both = F.size("x") + F.size("y") - common
    return links.select("a", "b").join(one, "a").join(two, "b").where(common * down >= both * up).select("a", "b")


def _true(links: DataFrame, known: DataFrame | None, rows: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """``known`` links and as many verified ones of ``links`` as have the same components as all of them."""
    wanted = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    firsts = nodes.join(wanted, "node").select(F.col("first").alias("id")).distinct()
    texts = rows.join(firsts, "id", "left_semi").select("id", "text")
    sets = texts.mapInArrow(frugal(_sets(shingle)), "node long, shingles array<long>")
    # a row that repeats an id may hold another text, and several rows one text
    sets = cut(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    place = F.row_number().over(Window.partitionBy("a").orderBy("apart", "b"))
    nearest = links.withColumn("place", place).where(F.col("place") <= NEAREST).select("a", "b")
    true = verified(nearest, sets)
    true = cut(true if known is None else known.union(true), "nearest")
    roots = components(true)
    rooted = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    apart = (
        links.join(rooted("a"), "a", "left")
        .join(rooted("b"), "b", "left")
        .where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b"))
        .join(nearest, ["a", "b"], "left_anti")
    )
    return cut(true.union(verified(apart, sets)), "verified")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``id, node, component`` for every row: the component is the smallest id that links of ``SIMILARITY`` reach."""
    rows = docs.select(id_column(docs, doc_id).alias("id"), F.col(text).alias("text"))
    how = plan(rows.count())
    sketched = cut(rows.mapInArrow(frugal(_sketch(shingle, how.words)), "id long, node long, size long, sketch binary"), "sketches")
    nodes = cut(sketched.groupBy("node").agg(F.min("id").alias("first"), F.first("size").alias("size"), F.first("sketch").alias("sketch")), "nodes")
    todo, leaders, judged, true = nodes.where("sketch is not null").select("node", "size", "sketch"), LEADERS, None, None
    while True:
        rooted = judged is not None
        blocks = todo.mapInArrow(frugal(_deal(how, rooted)), "shard long, block binary")
        meet = _meet(how.bits - how.deal, how.deal, leaders, rooted, True)
        met = blocks.groupBy("shard").applyInArrow(meet, "a long, b long, apart int")
        met = cut(met.groupBy("a", "b").agg(F.min("apart").alias("apart")), "links")
        links = met.where("a <> b")
        if rooted:  # what was refuted already
            links = cut(links.join(judged, ["a", "b"], "left_anti"), "links")
        if not rooted or not links.isEmpty():
            true = _true(links, true, rows, nodes, shingle)
            roots = components(true)
        judged = links.select("a", "b") if judged is None else judged.union(links.select("a", "b"))
        unheld = met.where("a = b").select(F.col("a").alias("node"))
        if unheld.isEmpty():
            break
        todo = cut(nodes.join(unheld, "node").join(roots, "node", "left").select("node", "first", "size", "sketch", F.coalesce("root", "node").alias("root")), "unheld")
        texts = rows.join(todo.select(F.col("first").alias("id")), "id", "left_semi").select("id", "text")
        long = texts.mapInArrow(frugal(_sketch(shingle, LONG_BITS // 64)), "id long, node long, size long, sketch binary")
        long = long.groupBy("node").agg(F.first("sketch").alias("long"))
        todo = todo.join(long, "node").select("node", "size", "sketch", "root", "long")
        leaders *= MORE
    classed = nodes.select("node", "first").join(roots, "node", "left").select(
        "node", "first", F.coalesce("root", "node").alias("root")
    )
    least = classed.groupBy("root").agg(F.min("first").alias("component"))
    classes = classed.join(least, "root").select("node", "component")
    return sketched.select("id", "node").join(classes, "node").select("id", "node", "component")


def keep_first(docs: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
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
