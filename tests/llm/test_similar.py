from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from llm_tools import ODD, frame, lower, words

import corpus_pipeline
from tidemark.llm import similar as S
from tidemark.llm.components import forest


def shingle_set(text, k=5):
    w = words(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def similar(a, b):
    return bool(a | b) and 5 * len(a & b) >= 4 * len(a | b)


def roots(sets):
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if similar(sets[i], sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def edited(dice, text, edits):
    w = text.split()
    for at in dice.sample(range(len(w)), edits):
        w[at] = f"new{dice.randrange(10**9)}"
    return " ".join(w)


def pairs(rng, n, common, alone):
    """``n`` pairs of random sets that share ``common`` elements and have ``alone`` of their own each; sorted."""
    for _ in range(n):
        both = rng.integers(0, 1 << 63, common + sum(alone), dtype=np.uint64)
        yield np.sort(both[: common + alone[0]]), np.sort(np.concatenate((both[:common], both[common + alone[0] :])))


def test_pairs_of_the_least_similarity_meet():
    """Sets of similarity 0.8, small and large, alike in size or not: next to all share a variant and are near in the check."""
    rng = np.random.default_rng(5)
    for n_docs in (100, 10_000_000):
        how = S.plan(n_docs)
        assert how.bits * how.tables + S.CHECK_BITS <= 64 * how.words
        for common, alone in ((4, (0, 1)), (8, (0, 2)), (8, (1, 1)), (16, (2, 2)), (40, (5, 5)), (40, (0, 10)), (400, (50, 50))):
            sets = [x for pair in pairs(rng, 1500, common, alone) for x in pair]
            sizes = np.array([len(x) for x in sets])
            raw = S.sketches(np.concatenate(sets), sizes, how.words)
            bits = np.unpackbits(raw.view(np.uint8).reshape(len(sets), -1), axis=1, bitorder="little")
            apart = bits[::2] != bits[1::2]
            tables = apart[:, : how.bits * how.tables].reshape(-1, how.tables, how.bits).sum(axis=2)
            near = apart[:, -S.CHECK_BITS :].sum(axis=1) <= (S.CHECK_FEW if sizes.min() < S.FEW else S.CHECK_NEAR)
            assert ((tables <= S.RADIUS).any(axis=1) & near).mean() >= (0.995 if common > 4 else 0.98), (n_docs, common, alone)


def test_votes_and_sets():
    rng = np.random.default_rng(3)
    sizes = [1, 2, 700, 255, 256, 3]
    hashes = rng.integers(0, 1 << 63, sum(sizes), dtype=np.uint64)
    first = np.cumsum(sizes) - sizes
    want = [[sum(int(h) >> b & 1 for h in hashes[a : a + n]) for b in range(64)] for a, n in zip(first.tolist(), sizes)]
    assert S._votes(hashes, first).tolist() == want
    texts = ["a b c d e f", "A b C d e f", "a b", "b a", None, "x " * 50]
    node, flat, n_sh = next(S.shingle_sets(pa.array(texts)))
    assert n_sh.tolist() == [2, 2, 1, 1, 0, 1] and node[0] == node[1] and len(set(node.tolist())) == 5
    assert flat[:2].tolist() == flat[2:4].tolist()


def test_leaders_leave_no_near_member_out():
    """Every member of a bucket that doesn't lead is linked to a leader, in steps as at once."""
    rng = np.random.default_rng(8)
    centre = rng.integers(0, 1 << 63, (5, S.CHECK_BITS // 64), dtype=np.uint64)
    entries = np.empty(400, S._ENTRY)
    which = rng.integers(0, 5, 400)
    noise = np.uint64(1) << rng.integers(0, 64, (400, S.CHECK_BITS // 64)).astype(np.uint64)
    entries["key"], entries["size"] = rng.integers(0, 4, 400), 50
    entries["check"] = centre[which] ^ noise
    entries["node"] = rng.permutation(400)
    before = S.STEP, S.RANGE
    for step in ((7, 10**6), (100, 10**6), (10_000, 10**6), (10_000, 300), (100, 20)):
        S.STEP, S.RANGE = step
        try:
            block = pa.table({"shard": [3], "block": pa.array([entries.tobytes()], pa.binary())})
            links = S._meet(2)(block).to_pydict()
        finally:
            S.STEP, S.RANGE = before
        group = dict(zip(entries["node"].tolist(), which.tolist()))
        assert all(group[a] == group[b] and a > b for a, b in zip(links["a"], links["b"]))
        node, _ = forest(np.array(links["a"]), np.array(links["b"]))
        assert len(node) == 400 - 5


def test_stage_finds_planted_near_copies(spark):
    """Copies with 1 to 14 of 250 words changed, similarities from under 0.6 to over 0.95, against brute force."""
    dice = random.Random(7)
    base = [" ".join(f"w{dice.randrange(3000)}" for _ in range(250)) for _ in range(60)]
    texts = base + [edited(dice, t, 1 + i % 14) for i, t in enumerate(base)] + [edited(dice, t, 1 + i % 6) for i, t in enumerate(base)]
    texts += [base[0].upper(), "two words", "two  WORDS", "", None] + [edited(dice, base[1], 2) for _ in range(60)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    sets = [shingle_set(t) for t in texts]
    want = roots(sets)
    assert sum(similar(sets[i], sets[i + 60]) for i in range(60)) >= 15
    want[texts.index(None)] = want[texts.index("")]  # wordless texts are one
    docs = frame(spark, rows)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {i for i, r in enumerate(want) if r == i}


def test_odd_rows(spark):
    rows = [*ODD, (30, ODD[4][1] + " more", "en", "s", 0)]
    kept = S.keep_first(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    # the wordless: 3, 4 and 6; a longer copy of 5, whose rows both stay
    assert sorted(kept.collect(), key=repr) == sorted(
        frame(spark, [r for r in ODD if r[0] not in (4, 6)]).collect(), key=repr
    )
    assert S.keep_first(frame(spark, [])).count() == 0


def test_no_near_pair_is_left_unheld():
    """Pairs of a bucket that neither leads are marked, and held against each other in the rounds that follow, down to none."""
    rng = np.random.default_rng(12)
    entries = np.zeros(300, S._ROOTED)
    entries["key"], entries["size"], entries["node"] = 0, 50, rng.permutation(300)
    entries["root"] = entries["node"]  # no link has been verified
    entries["check"] = np.uint64(1) << rng.integers(0, 64, (300, S.CHECK_BITS // 64)).astype(np.uint64)
    found, leaders = set(), S.LEADERS
    plain = np.zeros(300, S._ENTRY)
    for name in S._ENTRY.names:
        plain[name] = entries[name]
    for number in range(4):
        own = plain if not number else entries[np.isin(entries["node"], left)]
        block = pa.table({"shard": [0], "block": pa.array([own.tobytes()], pa.binary())})
        rows = S._meet(0, 0, leaders, number > 0, True)(block).to_pydict()
        found |= {(a, b) for a, b in zip(rows["a"], rows["b"]) if a != b}
        left = [a for a, b in zip(rows["a"], rows["b"]) if a == b]
        if not left:
            break
        leaders *= S.MORE
    assert not left and len(found) == 300 * 299 // 2


def test_classes_among_many_false_candidates(spark):
    """Texts of one boilerplate, most pairs near in the check and few of them links: the classes are those of brute force."""
    dice = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for family in range(40):  # boilerplate of which a part is changed: most pairs are near in the check, few are links
        own = list(base)
        for k in range(4):
            own[dice.randrange(120)] = f"f{family}_{k}"
        texts.append(" ".join(own))
        own[dice.randrange(120)] = f"g{family}"
        texts.append(" ".join(own))
    sets = [shingle_set(t) for t in texts]
    want = roots(sets)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    kept = {r["doc_id"] for r in S.keep_first(frame(spark, rows)).collect()}
    assert kept == {i for i, r in enumerate(want) if r == i}


def entries_of(rng, how, sizes, copies):
    """Random sets of which the first ``copies`` are near copies of one, as entries packed by shard."""
    own = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in sizes]
    for i in range(1, copies):
        own[i] = own[0].copy()
        own[i][rng.choice(len(own[0]), len(own[0]) // 25, replace=False)] = rng.integers(0, 1 << 63, len(own[0]) // 25, dtype=np.uint64)
    raw = S.sketches(np.concatenate([np.sort(x) for x in own]), np.array([len(x) for x in own]), how.words)
    batch = pa.record_batch(
        [pa.array(rng.permutation(len(own))), pa.array([len(x) for x in own]), pa.array([k.tobytes() for k in raw], pa.binary())],
        names=["node", "size", "sketch"],
    )
    return pa.Table.from_batches(S._deal(how)([batch]))


def met(how, blocks):
    """What all shards make, rows and all."""
    shards = sorted(set(blocks.column("shard").to_pylist()))
    of = S._meet(how.bits - how.deal, how.deal, None, False, True)
    return pa.concat_tables([of(blocks.filter(pa.compute.equal(blocks.column("shard"), s))) for s in shards])


def test_a_large_shard_marks_followers_only(monkeypatch):
    """Texts that are met in small steps or ranges make the rows they make at once; unlike ones are marked at no size of a shard."""
    rng = np.random.default_rng(4)
    how = S.Plan(12, 3, 1)
    blocks = entries_of(rng, how, [60] * 600, 40)
    want = sorted(zip(*met(how, blocks).to_pydict().values()))
    assert len({a for a, b, _ in want if a == b}) <= 40 < len(want)
    for step, size in ((500, 10**6), (10**6, 50), (20, 3)):
        monkeypatch.setattr(S, "STEP", step)
        monkeypatch.setattr(S, "RANGE", size)
        assert sorted(zip(*met(how, blocks).to_pydict().values())) == want


def test_rows_grow_with_the_group():
    """Five times the near copies among five times the texts make about five times the rows."""
    rng = np.random.default_rng(6)
    how = S.plan(40_000)
    small, large = (met(how, entries_of(rng, how, [100] * n, n // 4)).num_rows for n in (400, 2000))
    assert small > 400 and large <= 8 * small


def test_pairs_of_the_least_similarity_meet_where_they_are_dealt():
    """The top bits by which tables are dealt agree and the others differ in few, in some table, at small and large plans."""
    rng = np.random.default_rng(9)
    for n_docs in (1_000_000, 12_000_000):
        how = S.plan(n_docs)
        assert how.deal > 1
        for common, alone in ((4, (0, 1)), (8, (1, 1)), (16, (2, 2)), (40, (5, 5)), (40, (0, 10)), (400, (50, 50))):
            sets = [x for pair in pairs(rng, 1500, common, alone) for x in pair]
            raw = S.sketches(np.concatenate(sets), np.array([len(x) for x in sets]), how.words)
            bits = np.unpackbits(raw.view(np.uint8).reshape(len(sets), -1), axis=1, bitorder="little")[:, : how.bits * how.tables]
            apart = (bits[::2] != bits[1::2]).reshape(-1, how.tables, how.bits)
            top = apart[:, :, how.bits - how.deal :].any(axis=2)
            meet = (~top & (apart.sum(axis=2) <= S.RADIUS)).any(axis=1)
            assert meet.mean() >= (0.995 if common > 4 else 0.98), (n_docs, common, alone, meet.mean())


def test_a_group_makes_few_links_a_node_and_loses_none():
    """The first round makes ``NEAREST`` links a node and shard; whoever has others is marked, to be met again unless in one component."""
    rng = np.random.default_rng(2)
    how = S.Plan(6, 1, 0)
    blocks = entries_of(rng, how, [200] * 300, 200)
    rows = met(how, blocks).to_pydict()
    links = {(a, b) for a, b in zip(rows["a"], rows["b"]) if a != b}
    marks = {a for a, b in zip(rows["a"], rows["b"]) if a == b}
    of = {a: sum(x == a for x, _ in links) for a, _ in links}
    assert max(of.values()) <= S.NEAREST
    every = set(zip(*[S._meet(6)(blocks).to_pydict()[c] for c in "ab"]))
    assert links < every and {x for pair in every - links for x in pair} <= marks
