from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tools import ODD, frame, lower, words

from tidemark.llm import simhash as S
from tidemark.llm.components import components, forest


def fingerprint(text, shingle=3):
    w = words(lower(text or ""))
    parts = [" ".join(w[i : i + shingle]) for i in range(max(len(w) - shingle + 1, 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abAB \n\té漢", max_size=30)), max_size=6), st.integers(1, 5))
def test_fingerprints(texts, shingle):
    got = S.fingerprints(pa.array(texts, pa.string()), shingle).tolist()
    assert got == [fingerprint(t, shingle) for t in texts]


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_every_pair_within_three_bits_is_connected(spark):
    dice = random.Random(2)
    found = {0}
    for _ in range(40):
        base = dice.getrandbits(64)
        found.add(base)
        for flips in (1, 2, 3, 3, 4, 5):
            x = base
            for bit in dice.sample(range(64), flips):
                x ^= 1 << bit
            found.add(x)
    nodes = sorted(signed(x) for x in found)
    bits = {signed(x): x for x in found}
    linked = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if (bits[a] ^ bits[b]).bit_count() <= 3]
    links = S.ball_links(spark.createDataFrame([(n,) for n in nodes], "fp long"), len(nodes))
    assert all((bits[r["a"]] ^ bits[r["b"]]).bit_count() >= 1 for r in links.collect())
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert {n: got.get(n, n) for n in nodes} == groups(nodes, linked)


def test_variants_cover_all_triples():
    # one fingerprint of the two is even; two of three bits lie in one half
    pairs = {int(x) for x in S.FLIPS[S.NEAR :]}
    dice = random.Random(4)
    for _ in range(2000):
        p, q, r = (1 << b for b in dice.sample(range(64), 3))
        assert {p | q, p | r, q | r} & pairs
    assert len(S.FLIPS) == 1057


def test_components(spark):
    dice = random.Random(5)
    edges = [(dice.randrange(200), dice.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(60)]
    edges += [(500, 500 + i) for i in range(1, 100)] + [(7, 7), (1, 2), (1, 2)]
    frame_ = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")
    nodes = {x for e in edges for x in e}
    want = groups(nodes, edges)
    got = {r["node"]: r["root"] for r in components(frame_).collect()}
    assert {n: got.get(n, n) for n in nodes} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    a, b = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
    node, root = forest(a, b)
    assert dict(zip(node.tolist(), root.tolist())) == {n: r for n, r in want.items() if n != r}


def test_near_duplicates(spark):
    rows = [*ODD, (20, "Hello there big WORLD", "en", "s", 0), (21, "hello\nthere  big world", "en", "s", 0)]
    got = S.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    place = lambda i: -(2**63) if i is None else i
    prints = collections_of(rows, place)
    fps = sorted({f for v in prints.values() for f in v})
    linked = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3]
    root = groups(fps, linked)
    least: dict = {}
    for i, v in prints.items():
        for f in v:
            least[root[f]] = min(i, least.get(root[f], i))
    for r in got:
        fp = r["fp"] & (2**64 - 1)
        assert fp in prints[r["id"]] and r["component"] == least[root[fp]]
    kept = S.keep_first(frame(spark, rows), shingle=3)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert 21 not in {r["doc_id"] for r in kept.collect()}
    assert S.near_duplicates(frame(spark, [])).count() == 0 and S.keep_first(frame(spark, [])).count() == 0


def collections_of(rows, place):
    out: dict = {}
    for i, text, *_ in rows:
        out.setdefault(place(i), set()).add(fingerprint(text))
    return out


def test_one_large_group(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(i, text, "en", "s", 0) for i in range(400)] + [(1000 + i, f"{text} extra{i}", "en", "s", 0) for i in range(100)]
    got = S.near_duplicates(frame(spark, rows))
    assert got.where("id < 400").select("component").distinct().collect()[0]["component"] == 0
