"""Line deduplication with DataFrame functions only.

Lines are exploded with their position, normalised and hashed to 128 bits; one aggregation finds
the hashes that at least ``min_docs`` documents hold and the first document of each; a join by hash
gives the positions to drop, and each text is put together again from the positions that stay. Text
itself is shuffled once at most (to meet its own drop list); lines travel as hashes.

A very frequent line is one row a task after the map-side aggregation, and the join by hash is a
plain equi-join whose large partitions adaptive execution splits.

Defined results: a null text is an empty one (one empty line); a null id is a document of its own,
before all others; rows that repeat an id are one document, and each is cut by its own positions;
columns named like the outputs are replaced; names starting with ``__td_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_CHARS, ascii_lower, cut, id_column


def line_key(line: Column) -> Column:
    """The normal form of a line: separators stripped at both ends, ``A-Z`` lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def _lines(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    whole = F.coalesce(docs[text], F.lit(""))
    return (
        docs.select(
            id_column(docs).alias("__td_id"),
            F.xxhash64(whole).alias("__td_text"),
            F.posexplode(F.split(whole, "\n", -1)).alias("__td_pos", "__td_line"),
        )
        .withColumn("__td_key", line_key(F.col("__td_line")))
        .where(F.char_length("__td_key") >= min_chars)
        .select(
            "__td_id",
            "__td_text",
            "__td_pos",
            F.xxhash64("__td_key").alias("__td_h1"),
            F.xxhash64(F.lit("second"), F.col("__td_key")).alias("__td_h2"),
        )
    )


def dropped_positions(docs: DataFrame, *, text: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``__td_id, __td_text`` (hash of the text) and the sorted ``__td_drop`` positions, where there are any."""
    lines = _lines(docs, text, min_chars)
    if min_docs == 2:
        # two documents hold a line exactly if its smallest and largest ids differ: no distinct needed
        held = lines.groupBy("__td_h1", "__td_h2").agg(
            F.min("__td_id").alias("__td_first"), F.max("__td_id").alias("__td_last")
        )
        held = held.where("__td_first < __td_last")
    else:
        held = (
            lines.groupBy("__td_h1", "__td_h2", "__td_id")
            .agg(F.lit(1).alias("__td_one"))
            .groupBy("__td_h1", "__td_h2")
            .agg(F.min("__td_id").alias("__td_first"), F.count("*").alias("__td_n"))
            .where(F.col("__td_n") >= min_docs)
        )
    # written, so that the join's two sides are plain exchanges, of which adaptive execution can split a frequent line's
    held = cut(held.select("__td_h1", "__td_h2", "__td_first"), "held-lines")
    return (
        lines.join(held, ["__td_h1", "__td_h2"])
        .where("__td_id <> __td_first")
        .groupBy("__td_id", "__td_text")
        .agg(F.collect_set("__td_pos").alias("__td_drop"))
    )


def line_dedup(docs: DataFrame, *, text: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with ``text`` freed of repeated lines, and ``n_lines`` (before) and ``n_dropped``.

    A line whose key has ``min_chars`` code points or more and is found in ``min_docs`` documents or
    more stays only in the smallest ``doc_id`` that holds it.
    """
    drops = dropped_positions(docs, text=text, min_chars=min_chars, min_docs=min_docs)
    own = docs.drop("n_lines", "n_dropped")
    whole = F.coalesce(own[text], F.lit(""))
    keyed = own.withColumns({text: whole, "__td_id": id_column(own), "__td_text": F.xxhash64(whole)})
    lines = F.split(F.col(text), "\n", -1)
    joined = keyed.join(drops, ["__td_id", "__td_text"], "left").withColumns(
        {"__td_lines": lines, "__td_n": F.coalesce(F.size("__td_drop"), F.lit(0))}
    )
    stay = F.array_except(F.sequence(F.lit(0), F.size("__td_lines") - 1), F.col("__td_drop"))
    kept = F.when(F.col("__td_drop").isNull(), F.col(text)).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(F.col("__td_lines"), i)), "\n")
    )
    n_dropped = F.when(F.col("__td_drop").isNull(), F.lit(0)).otherwise(F.size("__td_drop"))
    return joined.withColumns(
        {text: kept, "n_lines": F.size("__td_lines").cast("long"), "n_dropped": n_dropped.cast("long")}
    ).select(*own.columns, "n_lines", "n_dropped")


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Line dedup of all documents, as counts and a digest of what is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, i AS pos, parts[i] AS line,
         translate(trim(parts[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), held AS (
  SELECT key, min(doc_id) AS first_id FROM lines WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT l.doc_id, l.pos, l.line, (h.key IS NOT NULL AND l.doc_id <> h.first_id) AS dropped
  FROM lines l LEFT JOIN held h ON l.key = h.key AND length(l.key) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
