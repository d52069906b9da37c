from __future__ import annotations

import collections
import math
import re

from llm_tools import LONG, ODD, frame, lower, words
from pyspark.sql import functions as F

from tidemark.llm import quality_rules as Q
from tidemark.llm.line_dedup import line_dedup


def expected_lines(rows, least=2):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    place = lambda i: -(2**63) if i is None else i
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                held[key(line)].add(place(i))
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(held[key(x)]) >= least and min(held[key(x)]) != place(i))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    for least in (2, 3):
        got = line_dedup(frame(spark, ODD), min_docs=least)
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_dropped"]
        rows = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()]
        assert sorted(rows, key=repr) == expected_lines(ODD, least)


def test_line_dedup_edges(spark):
    assert line_dedup(frame(spark, [])).count() == 0
    many = [(i, f"one very common line\nown line of document {i}\n" + "short\n" * 3, "en", "s", 0) for i in range(300)]
    clash = frame(spark, many).withColumns({"n_lines": F.lit("old"), "key": F.lit(1), "pos": F.lit(2)})
    got = line_dedup(clash)
    assert got.where("n_dropped = 1").count() == 299 and dict(got.dtypes)["n_lines"] == "bigint"
    assert got.select("key", "pos").distinct().count() == 1


def expected_counts(text):
    w = words(text)
    n = len(w)
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    covered = {j for i in range(n - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark):
    texts = [r[1] for r in ODD] + ["a b c a b c a b c d", "a a a a a", "x y z\nx y z\nx y z", "a b", "# * $ x|<y>&%", "a b c d a b c x b c d"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in Q.quality_rules(frame(spark, rows)).collect()}
    for i, t, *_ in rows:
        r, e = got[i], expected_counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == e, t
        assert r["base_failed"] == (e[0] < 50 or 100 * e[4] > 50 * e[0])
        assert not (r["base_failed"] and r["kept"])


def js(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / c) for a, c in zip(x, m) if a > 0)
    return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def test_distance(spark):
    row = spark.createDataFrame([([1, 3, 0, 4], [0.5, 0.0, 0.25, 0.25])], "h array<long>, r array<double>")
    got = row.select(Q.js_distance(F.col("h"), F.col("r")).alias("d")).first()["d"]
    assert abs(got - js([1 / 8, 3 / 8, 0, 4 / 8], [0.5, 0.0, 0.25, 0.25])) < 1e-12
    ends = spark.createDataFrame([([1, 0], [0.0, 1.0]), ([2, 2], [0.5, 0.5]), ([0, 0], [0.5, 0.5])], "h array<long>, r array<double>")
    found = [r["d"] for r in ends.select(Q.js_distance(F.col("h"), F.col("r")).alias("d")).collect()]
    assert abs(found[0] - 1) < 1e-12 and abs(found[1]) < 1e-9 and 0 <= found[2] <= 1


def test_junk_goes_and_prose_stays(spark):
    import random

    dice = random.Random(1)
    vocabulary = ["the", "of", "and", "to", "in"] * 8 + [f"w{chr(97 + i)}{chr(97 + j)}er" for i in range(20) for j in range(20)]
    prose = [" ".join(dice.choice(vocabulary) for _ in range(200)) for _ in range(120)]
    junk = [" ".join(dice.choice(vocabulary).upper() + "!!###" for _ in range(200)) for _ in range(10)]
    rows = [(i, t, "en" if i % 10 else None, "s", 0) for i, t in enumerate(prose + junk)]
    docs = frame(spark, rows).withColumn("kept", F.lit("mine"))
    judged = {r["doc_id"]: r["kept"] for r in Q.quality_rules(docs).collect()}
    assert all(judged[i] for i in range(120)) and not any(judged[i] for i in range(120, 130))
    kept = Q.rules_filter(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(120))
    assert kept.first()["kept"] == "mine"


def test_rules_edges(spark):
    assert Q.quality_rules(frame(spark, [])).count() == 0 and Q.rules_filter(frame(spark, [])).count() == 0
    assert LONG and Q.rules_filter(frame(spark, ODD)).count() <= len(ODD)


def test_rare_languages(spark):
    """A language of few of the documents has its own reference; one of too little text isn't judged."""
    import random

    dice = random.Random(2)
    english = ["the", "of", "and", "to", "in"] * 8 + [f"w{chr(97 + i)}{chr(97 + j)}er" for i in range(10) for j in range(10)]
    other = [f"k{chr(97 + i)}{chr(97 + j)}a" for i in range(15) for j in range(15)]
    prose = lambda words_, n: " ".join(dice.choice(words_) for _ in range(n))
    rows = [(i, prose(english, 60), "en", "s", 0) for i in range(12_000)]
    rows += [(20_000 + i, prose(other, 200), "rare", "s", 0) for i in range(11)] + [(30_000, prose(other, 200), "lone", "s", 0)]
    rows += [(40_000, prose(english, 200).upper() + " ###" * 60, "rare", "s", 0)]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r for r in Q.quality_rules(docs).where("doc_id >= 20000").collect()}
    assert all(got[20_000 + i]["kept"] and got[20_000 + i]["word_distance"] is not None for i in range(11))
    assert got[30_000]["kept"] and got[30_000]["word_distance"] is None
    assert not got[40_000]["kept"] and not got[40_000]["base_failed"]
    kept = {r["doc_id"] for r in Q.rules_filter(docs).where("doc_id >= 20000").collect()}
    assert kept == {20_000 + i for i in range(11)} | {30_000}


def test_rules_equal_their_sql(spark, tmp_path):
    """Rare languages, a language of too little text, null languages and texts: the query and its SQL say the same."""
    import random

    import duckdb

    dice = random.Random(5)
    english = ["the", "of", "and", "to", "in"] * 8 + [f"w{chr(97 + i)}{chr(97 + j)}er" for i in range(10) for j in range(10)]
    other = [f"k{chr(97 + i)}{chr(97 + j)}a" for i in range(15) for j in range(15)]
    prose = lambda words_, n: " ".join(dice.choice(words_) for _ in range(n))
    rows = [(i, prose(english, 60 + i), "en" if i % 7 else None, "s", 0) for i in range(150)]
    rows += [(200 + i, prose(other, 200), "rare", "s", 0) for i in range(9)] + [(300, prose(other, 99), "lone", "s", 0)]
    rows += [(400 + i, prose(english, 99).upper() + " ###" * 60, lang, "s", 0) for i, lang in enumerate(("rare", None, "en"))]
    rows += [(500, None, "en", "s", 0), (501, "", None, "s", 0), (502, prose(other, 300), "en", "s", 0)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.op1_quality_divergence(spark, str(tmp_path))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duckdb.sql(Q.OP1_SQL)
    assert want.columns == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    kept = {r["doc_id"] for r in got.where("kept").collect()}
    assert not kept & {400, 401, 402, 502} and kept >= {300, *range(200, 209)}
