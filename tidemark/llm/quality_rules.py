"""Quality rules by distribution divergence, with DataFrame functions only.

Each document has two histograms: of character classes and of common words. The references are the
same histograms summed over all documents of a language that pass the base rules and aren't full of symbols or capitals (in
integers, so the sum doesn't depend on the order). A document is kept if it passes the base rules and the
Jensen-Shannon distance (base 2, 0 to 1) of each of its histograms to its language's reference is
within its limit; a histogram of too short a text isn't judged.

One pass over the texts makes a narrow table of counts (a few hundred bytes a document); everything after that
reads the table. Every language has a reference, however rare, unless its documents make fewer than
``REFERENCE_WORDS`` words; the references stand in a table that the counts are joined with by language.

Defined results: a null text has no words and fails the base rules; in a language without a reference the
distances are null and the base rules decide; with a null language the classes are held against those of all languages
together and the words aren't judged; rows that repeat an id are judged each for itself; columns named like the outputs
are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, cut, let

# Frequent function words of English, French, German and Spanish.
COMMON_WORDS = (
    "the of and to in is that it was for with as on are "
    "le la les de des du un une et en que est dans "
    "der die das und den von zu mit sich auf nicht ein ist "
    "el los las del se por con para su al lo"
).split()
SYMBOLS = r"[#*$%&|<>]"
CLASSES = ("lower", "upper", "digit", "symbol", "punctuation", "other", "space")
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Limits of the two distances, and the sizes from which they count. A histogram of n words is off its source by
#: chance, with a squared distance of about a constant over n, so the words' limit allows for that.
MAX_CLASS_DISTANCE = 0.22
MAX_WORD_DISTANCE_SQUARED = 0.03
WORD_NOISE = 4.0
MIN_CHARS_FOR_CLASSES = 300
MIN_WORDS_FOR_WORDS = 50
#: A language has a reference from so many words on: its own noise is then a tenth of the limit of the words at most.
REFERENCE_WORDS = 10 * WORD_NOISE / MAX_WORD_DISTANCE_SQUARED
#: A document shapes its language's reference if it has so many lower-case letters for a symbol, and for a capital.
REFERENCE_SYMBOLS = 50
REFERENCE_CAPITALS = 4


def _length_without(text: Column, pattern: str) -> tuple[Column, Column]:
    rest = F.regexp_replace(text, pattern, "")
    return rest, F.char_length(rest)


def repeated_words(hashes: Column) -> Column:
    """Words covered by three-word windows whose hash occurs twice or more."""

    def covered(pairs: Column) -> Column:
        def again(pair: Column, k: Column) -> Column:
            before = (k > 0) & (F.get(pairs, k - 1)["h"] == pair["h"])
            after = (k + 1 < F.size(pairs)) & (F.get(pairs, k + 1)["h"] == pair["h"])
            return F.when(before | after, pair["i"])

        at = F.array_sort(F.array_compact(F.transform(pairs, again)))

        def width(starts: Column) -> Column:
            sizes = F.transform(
                starts,
                lambda p, k: F.coalesce(F.least(F.lit(3), F.get(starts, k + 1) - p), F.lit(3)),
            )
            return F.aggregate(sizes, F.lit(0), lambda a, b: a + b)

        return let(at, width)

    placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
        let(F.sort_array(placed), covered)
    )


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with the base counts and the two histograms (``__td_classes``, ``__td_common``)."""
    clash = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    own = [c for c in docs.columns if c != text and c not in clash]
    whole = F.coalesce(F.col(text), F.lit(""))
    a = docs.select(*own, whole.alias("__td_text")).withColumns(
        {
            "__td_w": F.array_remove(F.split("__td_text", SPACE + "+", -1), ""),
            "__td_lines": F.filter(F.split("__td_text", "\n", -1), lambda x: x.rlike(r"[^ \t-\r]")),
            "__td_rest": F.regexp_replace("__td_text", r"[\p{Ll}\s]+", ""),
        }
    )
    n = F.size("__td_w")
    codes = {w: chr(48 + i) for i, w in enumerate(COMMON_WORDS)}
    code = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    known = F.filter("__td_w", lambda w: F.lower(w).isin(COMMON_WORDS))
    b = a.select(
        *own,
        n.cast("long").alias("n_words"),
        F.char_length("__td_text").cast("long").alias("__td_chars"),
        F.char_length(F.array_join("__td_w", "")).cast("long").alias("word_chars"),
        (F.size("__td_lines") - F.size(F.array_distinct("__td_lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            n >= 3,
            let(
                F.col("__td_w"),
                lambda w: F.transform(
                    F.sequence(F.lit(0), F.size(w) - 3),
                    lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
                ),
            ),
        )
        .otherwise(F.array().cast("array<long>"))
        .alias("__td_h"),
        "__td_rest",
        F.array_join(F.transform(known, lambda w: code[F.lower(w)]), "").alias("__td_codes"),
    )
    strip = {"symbol": SYMBOLS, "upper": r"\p{Lu}+", "digit": r"\p{Nd}+", "punctuation": r"\p{P}+"}
    rest, sizes, left = F.col("__td_rest"), {}, F.char_length("__td_rest")
    for name, pattern in strip.items():
        rest, after = _length_without(rest, pattern)
        sizes[name], left = left - after, after
    sizes["other"] = left
    sizes["space"] = F.col("__td_chars") - F.col("word_chars")
    sizes["lower"] = F.col("word_chars") - F.char_length("__td_rest")
    bins = [
        F.char_length("__td_codes") - F.char_length(F.replace("__td_codes", F.lit(c), F.lit("")))
        for c in codes.values()
    ]
    bins.append(F.col("n_words") - F.char_length("__td_codes"))
    return b.select(
        *own,
        "n_words",
        "word_chars",
        sizes["symbol"].cast("long").alias("n_symbols"),
        "n_dup_lines",
        repeated_words(F.col("__td_h")).cast("long").alias("n_repeat_words"),
        F.array(*[sizes[c].cast("long") for c in CLASSES]).alias("__td_classes"),
        F.array(*[x.cast("long") for x in bins]).alias("__td_common"),
        # not deterministic: without it, filters would be pushed below and compute all of this twice
        F.monotonically_increasing_id().alias("__td_barrier"),
    )


def _shares(histogram: Column) -> Column:
    total = F.aggregate(histogram, F.lit(0).cast("long"), lambda a, b: a + b)
    return let(total, lambda t: F.transform(histogram, lambda x: F.when(t > 0, x / t).otherwise(F.lit(0.0))))


def js_distance(histogram: Column, reference: Column) -> Column:
    """The Jensen-Shannon distance of a histogram of counts to a reference of shares, 0 to 1."""

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
        return part(p) + part(q)

    total = F.aggregate(F.zip_with(_shares(histogram), reference, term), F.lit(0.0), lambda a, b: a + b)
    return F.sqrt(F.greatest(F.lit(0.0), total / 2))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def references(counted: DataFrame, lang: str = "lang") -> DataFrame:
    """``__td_lang, __td_rc, __td_rw``: class shares and word shares of every language with enough text.

    Under the null language stand the class shares of all languages together, without word shares.
    """
    n = len(CLASSES), len(COMMON_WORDS) + 1
    sums = [F.sum(F.col("__td_classes")[i]).alias(f"c{i}") for i in range(n[0])]
    sums += [F.sum(F.col("__td_common")[i]).alias(f"w{i}") for i in range(n[1])]
    size = {c: F.col("__td_classes")[i] for i, c in enumerate(CLASSES)}
    # plainly odd texts don't shape a reference, however many they are
    plain = (size["symbol"] * REFERENCE_SYMBOLS <= size["lower"]) & (size["upper"] * REFERENCE_CAPITALS <= size["lower"])
    good = counted.where(F.col(lang).isNotNull() & ~base_failed() & plain & (F.col("__td_barrier") >= 0))
    by = cut(good.groupBy(F.col(lang).alias("__td_lang")).agg(*sums), "quality-sums")
    together = by.agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(n[0])], *[F.sum(f"w{i}").alias(f"w{i}") for i in range(n[1])])
    c, w = F.array(*[f"c{i}" for i in range(n[0])]), F.array(*[f"w{i}" for i in range(n[1])])
    enough = F.aggregate(w, F.lit(0).cast("long"), lambda a, b: a + b) >= F.lit(REFERENCE_WORDS)
    own = by.where(enough).select("__td_lang", _shares(c).alias("__td_rc"), _shares(w).alias("__td_rw"))
    none = F.lit(None)
    mixed = together.where(enough).select(
        none.cast("string").alias("__td_lang"), _shares(c).alias("__td_rc"), none.cast("array<double>").alias("__td_rw")
    )
    return cut(own.unionAll(mixed), "quality-references")


def judge(counted: DataFrame, refs: DataFrame, lang: str = "lang") -> DataFrame:
    """Adds ``base_failed``, ``class_distance``, ``word_distance`` and ``kept``."""
    with_distance = counted.join(refs, F.col(lang).eqNullSafe(F.col("__td_lang")), "left").withColumns(
        {
            name: F.when(F.col(r).isNotNull(), js_distance(F.col(h), F.col(r)))
            for name, h, r in (("class_distance", "__td_classes", "__td_rc"), ("word_distance", "__td_common", "__td_rw"))
        }
    ).drop("__td_lang", "__td_rc", "__td_rw")
    chars = reduce(lambda a, b: a + b, [F.col("__td_classes")[i] for i in range(len(CLASSES))])
    far = (chars >= MIN_CHARS_FOR_CLASSES) & (F.col("class_distance") > MAX_CLASS_DISTANCE)
    limit = F.lit(MAX_WORD_DISTANCE_SQUARED) + F.lit(WORD_NOISE) / F.greatest(F.col("n_words"), F.lit(1))
    off = F.col("word_distance") * F.col("word_distance")
    far |= (F.col("n_words") >= MIN_WORDS_FOR_WORDS) & (off > limit)
    return with_distance.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))
    )


OUTPUTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "base_failed", "kept", "class_distance", "word_distance",
]


def quality_rules(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without the text, with the counts, the distances and the verdict ``kept``."""
    own = [c for c in docs.columns if c != text and c not in OUTPUTS]
    counted = cut(counts(docs.select(*own, text), text), "quality-counts")
    return judge(counted, references(counted, lang), lang).select(*own, *OUTPUTS)


def rules_filter(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, in all their columns: written once beside their counts, then judged."""
    rows = docs.select(
        F.struct(*docs.columns).alias("__td_row"), F.col(lang).alias("__td_lang_of"), F.col(text).alias("__td_of")
    )
    counted = cut(counts(rows, "__td_of"), "quality-rows")
    refs = references(counted, "__td_lang_of")
    return judge(counted, refs, "__td_lang_of").where("kept").select("__td_row.*")


def op1_quality_divergence(spark, sf_dir: str) -> DataFrame:
    """The counts and the verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return quality_rules(docs).select("doc_id", *OUTPUTS[:7])


def _sql() -> str:
    """The same in SQL; where ids repeat or texts are long it is slow, but it says the same."""
    strip = [r"[#*$%&|<>]", r"\p{Lu}+", r"\p{Nd}+", r"\p{P}+"]
    rests = ["rest"]
    for pattern in strip:
        rests.append(f"regexp_replace({rests[-1]}, '{pattern}', '', 'g')")
    taken = [f"length({a}) - length({b})" for a, b in zip(rests, rests[1:])]
    symbol, upper, digit, punctuation = taken
    common = "[" + ", ".join(f"'{w}'" for w in COMMON_WORDS) + "]"
    share = "list_transform({h}, lambda x: CASE WHEN list_sum({h}) > 0 THEN x::DOUBLE / list_sum({h}) ELSE 0.0 END)"

    def distance(p: str, q: str) -> str:
        middle = f"(({p}[i] + {q}[i]) / 2)"
        part = lambda x: f"(CASE WHEN {x}[i] > 0 THEN {x}[i] * log2({x}[i] / {middle}) ELSE 0.0 END)"
        return f"sqrt(greatest(0.0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: {part(p)} + {part(q)})) / 2))"

    return rf"""
WITH base AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines,
         regexp_replace(coalesce(text, ''), '[\p{{Ll}} \t-\r]+', '', 'g') AS rest
  FROM documents
), placed AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM base)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM placed) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY doc_id
), counted AS (
  SELECT b.doc_id, b.lang, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, {symbol} AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, length(t) AS chars,
         [length(array_to_string(ws, '')) - length(rest), {upper}, {digit}, {symbol}, {punctuation}, length({rests[-1]}),
          length(t) - length(array_to_string(ws, ''))] AS classes,
         list_transform({common}, lambda w: len(list_filter(ws, lambda x: lower(x) = w))) AS common
  FROM base b LEFT JOIN covered c ON b.doc_id = c.doc_id
), judged AS (
  SELECT * EXCLUDE (common), list_append(common, n_words - list_sum(common)::BIGINT) AS common,
         n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM counted
), plain AS (
  SELECT lang, doc_id, classes, common FROM judged
  WHERE lang IS NOT NULL AND NOT base_failed AND classes[4] * {REFERENCE_SYMBOLS} <= classes[1]
    AND classes[2] * {REFERENCE_CAPITALS} <= classes[1]
), class_sums AS (
  SELECT lang, list(v ORDER BY i) AS h FROM (
    SELECT lang, i, sum(v) AS v FROM (SELECT lang, unnest(range(1, len(classes) + 1)) AS i, unnest(classes) AS v FROM plain) GROUP BY lang, i)
  GROUP BY lang
), word_sums AS (
  SELECT lang, list(v ORDER BY i) AS h FROM (
    SELECT lang, i, sum(v) AS v FROM (SELECT lang, unnest(range(1, len(common) + 1)) AS i, unnest(common) AS v FROM plain) GROUP BY lang, i)
  GROUP BY lang
), large AS (
  SELECT w.lang, c.h AS c, w.h AS w FROM word_sums w JOIN class_sums c ON w.lang = c.lang WHERE list_sum(w.h) >= {REFERENCE_WORDS}
), mixed AS (
  SELECT list(v ORDER BY i) AS h FROM (
    SELECT i, sum(v) AS v FROM (SELECT unnest(range(1, len(classes) + 1)) AS i, unnest(classes) AS v FROM plain) GROUP BY i)
  WHERE (SELECT sum(list_sum(common)) FROM plain) >= {REFERENCE_WORDS}
), refs AS (
  SELECT lang, {share.format(h="c")} AS rc, {share.format(h="w")} AS rw FROM large
  UNION ALL SELECT NULL, {share.format(h="h")}, NULL FROM mixed WHERE h IS NOT NULL
), shares AS (
  SELECT *, {share.format(h="classes")} AS pc, {share.format(h="common")} AS pw FROM judged
), far AS (
  SELECT d.*, CASE WHEN rc IS NOT NULL THEN {distance("pc", "rc")} END AS class_distance,
         CASE WHEN rw IS NOT NULL THEN {distance("pw", "rw")} END AS word_distance
  FROM shares d LEFT JOIN refs r ON r.lang IS NOT DISTINCT FROM d.lang
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(
         (chars >= {MIN_CHARS_FOR_CLASSES} AND class_distance > {MAX_CLASS_DISTANCE})
         OR (n_words >= {MIN_WORDS_FOR_WORDS} AND word_distance * word_distance
             > {MAX_WORD_DISTANCE_SQUARED} + {WORD_NOISE} / greatest(n_words, 1)), false) AS kept
FROM far
"""


OP1_SQL = _sql()
