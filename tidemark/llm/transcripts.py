"""Chat transcripts: roles recovered by a hidden Markov model, turns rendered in one form.

A transcript is a sequence of segments; each gives one observation: the speaker marker of its first line (none, or a
system, user or assistant word in one of the usual forms), how long it is, how many lines it has, whether it asks or shows code or a list,
and whether it opens the transcript. Roles are the hidden states; their start, transition and emission probabilities are
counted on a bounded sample of labelled conversations (``MAX_TRAINING`` rows). Viterbi's best path gives the
roles; markers are stripped and every segment is rendered as a canonical turn.

Viterbi is a product of (max, +) matrices, so a conversation of any length is cut into chunks of ``CHUNK`` turns: each chunk is
reduced to its matrix, the matrices of a conversation (a few numbers a chunk) give the states at the borders, and each
chunk's path is traced between them. Equal to one pass over the whole, without a conversation in one task. Where a turn's number
is null or stands in more than ``CHUNK`` segments, these are cut by ranges of their text's hash, which orders them. Only
observations move for this; texts meet their roles in one join.

The query learns from one half of the conversations what it reports of the other, so no role is judged by itself.

Defined results: turns are ordered by number, nulls first, then by a hash of the text; rows that repeat conversation, turn and
text are one segment and get the same role; rows without a conversation are each a conversation of their own; a null
text is empty; ties between paths go to the first of system, user, assistant; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

ROLES = ("system", "user", "assistant")
# The words by which transcripts name speakers.
NAMES = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "question", "q", "me", "customer", "prompter"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "model", "gpt", "agent"),
}
CHUNK = 512
MAX_TRAINING = 50_000
SMOOTHING = 0.5
#: Weight of the product of an observation's parts beside the observation itself.
BACK_OFF = 0.5
SEED = 6_000_011
MARKERS, LENGTHS, LINES, FLAGS = 4, 6, 4, 4
_FORMS = r"(?i)^\s*(?:<\|(?:im_start\|>)?|#{{1,4}}\s*|\[|\*\*|>\s*)?({names})(?:\|>|\]|\*\*:?|\s*:|\s*\n)[ \t]*\n?"


def marker_pattern(role: str | None = None) -> str:
    """A segment's opening speaker marker: a name in brackets, as a heading, or with a colon."""
    names = NAMES[role] if role else [n for r in ROLES for n in NAMES[r]]
    return _FORMS.format(names="|".join(sorted(names, key=len, reverse=True)))


def with_observation(rows: DataFrame, text: str, name: str = "observed") -> DataFrame:
    """Adds the observation of each segment as one number, step by step so that no step is written out twice."""
    whole = F.coalesce(F.col(text), F.lit(""))
    marker = F.lit(0)
    for k, role in enumerate(ROLES):
        marker = F.when(whole.rlike(marker_pattern(role)), F.lit(k + 1)).otherwise(marker)
    own = rows.columns
    parts = rows.select(
        *own, marker.alias("__td_marker"), F.regexp_replace(whole, marker_pattern(), "").alias("__td_body")
    ).select(
        *own,
        "__td_marker",
        F.char_length("__td_body").alias("__td_size"),
        F.size(F.split("__td_body", "\n", -1)).alias("__td_lines"),
        F.rtrim(F.col("__td_body")).endswith("?").cast("int").alias("__td_asks"),
        F.col("__td_body").rlike(r"(?m)^\s*(```|[-*] |\d+\. )").cast("int").alias("__td_shows"),
    )
    over = lambda c, limits: sum(((F.col(c) >= x).cast("int") for x in limits), F.lit(0))
    length, many = over("__td_size", (40, 120, 300, 700, 1500)), over("__td_lines", (2, 4, 8))
    code = ((F.col("__td_marker") * LENGTHS + length) * LINES + many) * FLAGS
    return parts.select(*own, (code + F.col("__td_asks") * 2 + F.col("__td_shows")).alias(name))


@dataclass(frozen=True)
class Hmm:
    """Log probabilities: start[role], move[role, role], emit[role, observation]."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def weights(self, observed: np.ndarray) -> np.ndarray:
        """What each role of each segment adds."""
        return self.emit[:, observed].T

    def reduce(self, observed: np.ndarray) -> np.ndarray:
        """best[i, j]: the best path from role i before the chunk to role j at its end."""
        best = np.where(np.eye(len(ROLES), dtype=bool), 0.0, -np.inf)
        for gain in self.weights(observed):
            best = (best[:, :, None] + self.move[None]).max(axis=1) + gain
        return best

    def trace(self, observed: np.ndarray, before: int, last: int) -> list[int]:
        """The best path that leaves role ``before`` (-1: the start) and ends in role ``last``."""
        gains, back = self.weights(observed), []
        value = (self.start if before < 0 else self.move[before]) + gains[0]
        for gain in gains[1:]:
            step = value[:, None] + self.move
            back.append(step.argmax(axis=0))
            value = step.max(axis=0) + gain
        path = [last]
        for arrows in reversed(back):
            path.append(int(arrows[path[-1]]))
        return path[::-1]

    def borders(self, first: np.ndarray, later: list[np.ndarray]) -> list[int]:
        """The role at the end of each chunk, from the first one's values and the later ones' matrices."""
        value, back = first, []
        for matrix in later:
            step = value[:, None] + matrix
            back.append(step.argmax(axis=0))
            value = step.max(axis=0)
        ends = [int(value.argmax())]
        for arrows in reversed(back):
            ends.append(int(arrows[ends[-1]]))
        return ends[::-1]

    def opening(self, observed: np.ndarray) -> np.ndarray:
        """The values at the end of the first chunk."""
        value = self.start + self.weights(observed[:1])[0]
        for gain in self.weights(observed[1:]):
            value = (value[:, None] + self.move).max(axis=0) + gain
        return value

    def viterbi(self, observed: np.ndarray) -> list[int]:
        """The best path of a whole conversation."""
        return self.trace(observed, -1, int(self.opening(observed).argmax()))


def fit(labelled: DataFrame, most: int = MAX_TRAINING) -> Hmm:
    """Counts of a sample of whole conversations, in ``conv, turn, tie, observed, role``, of ``most`` rows or so."""
    sizes = labelled.where("role is not null").groupBy("conv").agg(F.count("*").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = min(1.0, most / max(1, total))
    drawn = F.pmod(F.xxhash64("conv", F.lit(SEED)), F.lit(1_000_000)) < int(1_000_000 * share)
    rows = labelled.where("role is not null").where(drawn).orderBy("conv", "turn", "tie").limit(2 * most).toArrow()
    n = len(ROLES)
    width = MARKERS * LENGTHS * LINES * FLAGS
    start, move, emit = np.zeros(n), np.zeros((n, n)), np.zeros((n, width))
    before = None
    for conv, role, seen in zip(*(rows.column(c).to_pylist() for c in ("conv", "role", "observed"))):
        if role not in ROLES:
            continue
        k = ROLES.index(role)
        if before is None or before[0] != conv:
            start[k] += 1
        else:
            move[before[1], k] += 1
        emit[k, seen] += 1
        before = (conv, k)
    # emissions are mixed with the product of their parts, so that unseen combinations are still told apart, alike for
    # frequent and rare roles
    parts = emit.reshape(n, MARKERS, LENGTHS, LINES, FLAGS)
    product_ = np.ones_like(parts)
    for axis in range(4):
        other = tuple(a + 1 for a in range(4) if a != axis)
        own = parts.sum(axis=other) + SMOOTHING
        own /= own.sum(axis=1, keepdims=True)
        shape = [n, 1, 1, 1, 1]
        shape[axis + 1] = own.shape[1]
        product_ = product_ * own.reshape(shape)
    seen = emit / np.maximum(emit.sum(axis=1, keepdims=True), 1)
    emit = (1 - BACK_OFF) * seen + BACK_OFF * product_.reshape(n, width)
    start, move = start + SMOOTHING, move + SMOOTHING
    return Hmm(
        np.log(start / start.sum()),
        np.log(move / move.sum(axis=1, keepdims=True)),
        np.log(emit / emit.sum(axis=1, keepdims=True)),
    )


def _matrices(hmm: Hmm):
    @F.arrow_udf("array<double>")
    def of(chunk: pa.Array, observed: pa.Array) -> pa.Array:
        out = []
        for first, seen in zip(chunk.to_pylist(), observed.to_pylist()):
            codes = np.array(seen, np.int64)
            out.append((hmm.opening(codes) if first else hmm.reduce(codes).ravel()).tolist())
        return pa.array(out, pa.list_(pa.float64()))

    return of


def _borders(hmm: Hmm):
    @F.arrow_udf("array<int>")
    def of(matrices: pa.Array) -> pa.Array:
        out = []
        for rows in matrices.to_pylist():
            parts = [np.array(r["m"]) for r in rows]
            out.append(hmm.borders(parts[0], [p.reshape(len(ROLES), len(ROLES)) for p in parts[1:]]))
        return pa.array(out, pa.list_(pa.int32()))

    return of


def _paths(hmm: Hmm):
    @F.arrow_udf("array<int>")
    def of(observed: pa.Array, before: pa.Array, last: pa.Array) -> pa.Array:
        rows = zip(observed.to_pylist(), before.to_pylist(), last.to_pylist())
        return pa.array([hmm.trace(np.array(o, np.int64), b, e) for o, b, e in rows], pa.list_(pa.int32()))

    return of


def _chunked(segments: DataFrame) -> DataFrame:
    """``segments`` with ``chunk``, in the order of turns: a block of ``CHUNK`` numbers, or ranges of ties in a block with a crowded one."""
    placed = segments.withColumn("block", F.floor(F.col("turn") / CHUNK).cast("long"))
    same = lambda *names: reduce(and_, [F.col(f"s.{n}").eqNullSafe(F.col(f"c.{n}")) for n in names])
    place = ("conv", "lone", "block")
    sizes = cut(placed.groupBy(*place, "turn").agg(F.count("*").alias("n")), "transcript-turns")
    crowded = sizes.where(F.col("n") > CHUNK).select(*place).distinct()
    own = sizes.alias("s").join(crowded.alias("c"), same(*place), "left_semi").select(
        *place, "turn", F.ceil(F.col("n") / CHUNK).alias("parts")
    )
    share = F.floor((F.col("s.tie") / F.lit(2.0**64) + F.lit(0.5)) * F.col("c.parts"))
    none = F.lit(-(2**62)).cast("long")
    first = F.coalesce(F.when(F.col("c.parts").isNull(), F.col("s.block") * CHUNK).otherwise(F.col("s.turn")), none)
    part = F.coalesce(F.least(share, F.col("c.parts") - 1), F.lit(0))
    return placed.alias("s").join(own.alias("c"), same(*place, "turn"), "left").select(
        *[F.col(f"s.{c}").alias(c) for c in segments.columns],
        F.struct(first.cast("long").alias("first"), part.cast("long").alias("part")).alias("chunk"),
    )


def decode(segments: DataFrame, hmm: Hmm) -> DataFrame:
    """``conv, lone, turn, tie, role``: the best path of every conversation; see the module for chunks."""
    chunks = _chunked(segments).groupBy("conv", "lone", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("turn", "tie", "observed"))).alias("rows")
    )
    chunks = cut(chunks, "transcript-chunks")
    least = chunks.groupBy("conv", "lone").agg(F.min("chunk").alias("first")).toDF("conv2", "lone2", "first")
    same = F.col("conv").eqNullSafe(F.col("conv2")) & F.col("lone").eqNullSafe(F.col("lone2"))
    opened = chunks.join(least, same).select(
        "conv", "lone", "chunk", "rows", (F.col("chunk") == F.col("first")).alias("opens")
    )
    seen = F.transform("rows", lambda r: r["observed"])
    reduced = opened.select("conv", "lone", "chunk", _matrices(hmm)(F.col("opens"), seen).alias("m"))
    ends = reduced.groupBy("conv", "lone").agg(F.sort_array(F.collect_list(F.struct("chunk", "m"))).alias("all"))
    borders = (
        ends.select("conv", "lone", F.col("all.chunk").alias("chunks"), _borders(hmm)(F.col("all")).alias("ends"))
        .select("conv", "lone", "ends", F.posexplode("chunks").alias("at", "chunk"))
        .select(
            F.col("conv").alias("conv2"),
            F.col("lone").alias("lone2"),
            F.col("chunk").alias("chunk2"),
            F.when(F.col("at") == 0, F.lit(-1)).otherwise(F.get("ends", F.col("at") - 1)).alias("before"),
            F.get("ends", F.col("at")).alias("last"),
        )
    )
    met = chunks.join(borders, same & (F.col("chunk") == F.col("chunk2"))).select(
        "conv", "lone", "rows", "before", "last"
    )
    path = _paths(hmm)(seen, F.col("before"), F.col("last"))
    names = F.array(*[F.lit(r) for r in ROLES])
    return (
        met.select("conv", "lone", "rows", path.alias("path"))
        .select("conv", "lone", F.explode(F.arrays_zip("rows", "path")).alias("x"))
        .select("conv", "lone", "x.rows.turn", "x.rows.tie", F.get(names, F.col("x.path")).alias("role"))
    )


def render(role: Column, text: Column) -> Column:
    """A canonical turn: the role on a line of its own, the text without its marker, an end mark."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), marker_pattern(), "")
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.btrim(body), F.lit("\n<|end|>"))


def _keyed(rows: DataFrame, conv: str, turn: str, text: str) -> DataFrame:
    """Adds ``conv, lone, turn, tie``: the conversation, what tells rows without one apart, the place and the text's hash."""
    tie = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    return rows.withColumns(
        {
            "__td_conv": F.col(conv),
            "__td_lone": F.when(F.col(conv).isNull(), F.xxhash64(F.col(turn), tie)),
            "__td_turn": F.col(turn).cast("long"),
            "__td_tie": tie,
        }
    )


def parse_transcripts(
    rows: DataFrame, hmm: Hmm, *, conv: str = "conv_id", turn: str = "turn", text: str = "text"
) -> DataFrame:
    """``rows`` with the recovered ``role`` and the canonical ``rendered`` turn; a column of those names is replaced."""
    own = [c for c in rows.columns if c not in ("role", "rendered")]
    keyed = _keyed(rows.select(*own), conv, turn, text)
    segments = (
        with_observation(keyed, text, "__td_seen")
        .groupBy("__td_conv", "__td_lone", "__td_turn", "__td_tie")
        .agg(F.first("__td_seen"))
        .toDF("conv", "lone", "turn", "tie", "observed")
    )
    found = decode(segments, hmm).toDF("__td_conv2", "__td_lone2", "__td_turn2", "__td_tie2", "__td_role")
    on = [F.col(f"__td_{k}").eqNullSafe(F.col(f"__td_{k}2")) for k in ("conv", "lone", "turn")]
    met = keyed.join(found, [*on, F.col("__td_tie") == F.col("__td_tie2")])
    return met.select(*own, F.col("__td_role").alias("role"), render(F.col("__td_role"), F.col(text)).alias("rendered"))


def learn(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", text: str = "text", role: str = "role") -> Hmm:
    """The model of labelled segments."""
    keyed = _keyed(rows.select(conv, turn, text, role), conv, turn, text).where(F.col(conv).isNotNull())
    return fit(
        with_observation(keyed, text, "__td_seen").select(
            F.col("__td_conv").alias("conv"),
            F.col("__td_turn").alias("turn"),
            F.col("__td_tie").alias("tie"),
            F.col("__td_seen").alias("observed"),
            F.col(role).alias("role"),
        )
    )


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """The turns of ``conversations`` as raw transcripts write them: every conversation in one of five marker styles, and a
    third of the turns without a marker. The role stays beside, for learning and comparing."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(5))
    bare = F.pmod(F.xxhash64("conv_id", "turn", F.lit(SEED)), F.lit(3)) == 0
    title = F.initcap("role")
    human = F.when(F.col("role") == "user", "Human").when(F.col("role") == "assistant", "AI").otherwise(title)
    letter = F.when(F.col("role") == "user", "Q").when(F.col("role") == "assistant", "A").otherwise(title)
    marks = (
        F.concat(title, F.lit(": ")),
        F.concat(human, F.lit(": ")),
        F.concat(F.lit("### "), title, F.lit("\n")),
        F.concat(F.lit("["), F.col("role"), F.lit("] ")),
        F.concat(letter, F.lit(": ")),
    )
    mark = F.lit("")
    for k, one in enumerate(marks):
        mark = F.when(style == k, one).otherwise(mark)
    mark = F.when(bare | F.col("role").isNull(), F.lit("")).otherwise(mark)
    return conversations.withColumn("text", F.concat(F.coalesce(mark, F.lit("")), F.coalesce("text", F.lit(""))))


def op6_transcript_hmm(spark, sf_dir: str) -> DataFrame:
    """Recovered role and canonical turn of every segment of the conversations written as transcripts."""
    raw = as_transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    half = F.pmod(F.xxhash64("conv_id", F.lit(SEED + 1)), F.lit(2))
    parsed = [parse_transcripts(raw.where(half == k).drop("role"), learn(raw.where(half != k))) for k in (0, 1)]
    return parsed[0].unionByName(parsed[1]).select("conv_id", "turn", "role", "rendered")
