"""Transcript parsing: a hidden Markov model over speaker markers and line features recovers roles by Viterbi, then turns are rendered.

The hidden states are the roles, the observations are lines. A conversation is
cut into segments of TURNS turn numbers. The best path over a segment from each
role to each role is a small max-plus matrix; the matrices of a conversation are
joined to find the roles at the borders, then each segment is decoded between
them. So a conversation of any length is decoded exactly, and no task holds more
than a segment's texts or a conversation's matrices.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import table
from tidemark.session import stage

ROLES = ("system", "user", "assistant")
TURNS = 128
#: Learned only from conversations for which crc32(conv_id as text) mod FOLDS is not HELD_OUT.
FOLDS, HELD_OUT = 5, 0
#: Chance that the speaker changes at an unmarked line inside a turn: labelled turns have one speaker each, so it is not learned from them.
SWITCH = 0.01
#: Before any count, this many markers of each kind told the truth, and that many did not.
TRUE, FALSE = 97, 3
#: Speaker names at the start of a line, by role.
MARKERS = ("system|context|instructions?", "user|human|customer|question|prompt|q|you|me", "assistant|ai|bot|agent|model|answer|response|a|gpt|support")
_MARKER = re.compile(r"^[\s>#*_\[(<|-]*(?:(%s)|(%s)|(%s))\s*\d*[\])>|*_]*\s*(?:[:>]|\|>|$)[*_]*\s*" % MARKERS, re.IGNORECASE)
#: Values of a line's features: place in its turn, length, question, stop at the end, list or code.
SIZES = (3, 4, 2, 2, 2)


@dataclass
class Model:
    """log probabilities: of the first role, of a role after one at a new turn, of each feature's values by role; and how often
    the markers at the first line of a turn, and at the others, name the speaker."""

    start: np.ndarray
    turn: np.ndarray
    line: np.ndarray
    features: list[np.ndarray]
    trust: tuple[float, float] = (TRUE / (TRUE + FALSE),) * 2


def lines(text: str | None) -> list[tuple[str, int, tuple[int, ...], str]]:
    """Lines of a turn: text without its speaker marker, marked role (-1: none), features, whole text. A turn without text is one empty line."""
    out = []
    parts = (text or "").split("\n")
    for k, line in enumerate(parts):
        found = _MARKER.match(line)
        role = found.lastindex - 1 if found else -1
        rest = line[found.end() :] if found else line
        size = sum(len(rest) >= n for n in (20, 80, 300))
        out.append((rest, role, (min(k, 2), size, int(rest.rstrip().endswith("?")), int(rest.rstrip()[-1:] in ".!"), int(bool(re.match(r"\s*(?:[-*•]\s|\d+[.)]\s|```|    )", rest)))), line))
    return out


def _paths(model: Model, units: list[tuple[bool, int, tuple[int, ...]]]) -> tuple[np.ndarray, np.ndarray]:
    """Per unit (new turn, marked role, features) the step scores [before, after], without and with its own emission."""
    step = np.array([model.turn if new else model.line for new, _, _ in units])
    emit = np.zeros((len(units), len(ROLES)))
    for k, (_, role, values) in enumerate(units):
        emit[k] = sum(table[:, v] for table, v in zip(model.features, values, strict=True))
        if role >= 0:
            trust = model.trust[0 if units[k][0] else 1]
            emit[k] += np.log(np.where(np.arange(len(ROLES)) == role, trust, (1 - trust) / (len(ROLES) - 1)))
            step[k] = 0  # a marker names the speaker anew
    return step, emit


def matrix(model: Model, units: list) -> np.ndarray:
    """Best score over the units from each role before them to each role of the last."""
    step, emit = _paths(model, units)
    best = step[0] + emit[0]
    for k in range(1, len(units)):
        best = (best[:, :, None] + step[k]).max(axis=1) + emit[k]
    return best


def decode(model: Model, units: list, before: int, last: int) -> list[int]:
    """Roles of the units on the best path from role ``before`` (-1: the start) to role ``last``."""
    step, emit = _paths(model, units)
    best = (model.start if before < 0 else step[0][before]) + emit[0]
    back = []
    for k in range(1, len(units)):
        by = best[:, None] + step[k]
        back.append(by.argmax(axis=0))
        best = by.max(axis=0) + emit[k]
    out = [last]
    for came in reversed(back):
        out.append(int(came[out[-1]]))
    return out[::-1]


def borders(model: Model, matrices: list[np.ndarray], first_emission: np.ndarray) -> list[tuple[int, int]]:
    """(role before, last role) of each segment of a conversation; ``first_emission`` is the best from the start over the first one."""
    best, back = first_emission, []
    for m in matrices[1:]:
        by = best[:, None] + m
        back.append(by.argmax(axis=0))
        best = by.max(axis=0)
    out = [int(best.argmax())]
    for came in reversed(back):
        out.append(int(came[out[-1]]))
    out = out[::-1]
    return list(zip([-1, *out[:-1]], out, strict=True))


def _units(texts: list[str | None]) -> list:
    return [(k == 0, role, values) for text in texts for k, (_, role, values, _) in enumerate(lines(text))]


def segments(turns: DataFrame) -> DataFrame:
    """(conv_id, segment, rows of (turn, text, role)) in order of turn, then text."""
    rows = turns.select("conv_id", "turn", "text", "role", F.floor(F.coalesce("turn", F.lit(0)) / TURNS).cast("long").alias("segment"))
    return stage(rows.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(F.struct("turn", "text", "role"))).alias("rows")), "segments")


def train(held: DataFrame) -> Model:
    """Counts of roles, of their order, of their lines' features (plus one each) and of true markers over all labelled turns of the open folds."""

    def count(batches):
        role_of = {r: k for k, r in enumerate(ROLES)}
        for batch in batches:
            seen: dict[tuple[int, int, int], int] = {}

            def add(*key):
                seen[key] = seen.get(key, 0) + 1

            for segment, rows in zip(batch.column("segment").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                roles = [role_of.get(x["role"], -1) for x in rows]
                if segment == 0 and roles[0] >= 0:
                    add(-1, roles[0], 0)
                for a, b in zip(roles, roles[1:], strict=False):
                    if a >= 0 and b >= 0:
                        add(-2, a, b)
                for role, x in zip(roles, rows, strict=True):
                    for k, (_, said, values, _) in enumerate(lines(x["text"]) if role >= 0 else ()):
                        if said >= 0:
                            add(-3, int(k > 0), int(said == role))
                        for f, v in enumerate(values):
                            add(f, role, v)
            keys = sorted(seen)
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.int32()) for i in range(3)), pa.array([seen[k] for k in keys], pa.int64())], names=["f", "role", "v", "n"])

    open_ = held.where(F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit(""))) % FOLDS != HELD_OUT)
    counts = open_.mapInArrow(count, "f int, role int, v int, n long").groupBy("f", "role", "v").agg(F.sum("n").alias("n")).collect()
    start, turn, features = np.ones(len(ROLES)), np.ones((len(ROLES), len(ROLES))), [np.ones((len(ROLES), n)) for n in SIZES]
    said = np.array([[FALSE, TRUE], [FALSE, TRUE]], float)
    for r in counts:
        if r.f == -1:
            start[r.role] += r.n
        elif r.f == -2:
            turn[r.role, r.v] += r.n
        elif r.f == -3:
            said[r.role, r.v] += r.n
        else:
            features[r.f][r.role, r.v] += r.n
    line = np.full((len(ROLES), len(ROLES)), SWITCH / (len(ROLES) - 1)) + np.eye(len(ROLES)) * (1 - SWITCH - SWITCH / (len(ROLES) - 1))
    norm = lambda a: np.log(a / a.sum(axis=-1, keepdims=True))
    return Model(norm(start), norm(turn), np.log(line), [norm(x) for x in features], tuple(float(x) for x in said[:, 1] / said.sum(axis=1)))


def parse(turns: DataFrame, model: Model | None = None) -> DataFrame:
    """Canonical turns of transcripts: conv_id, turn, part, role, given (the role column), text, rendered.

    ``turns`` has conv_id, turn, text and role; role is only learned from and
    passed through. Lines of a turn that the model gives to one speaker are one
    part. A marker is taken off only where a part begins and the part's role is
    the one it names; elsewhere it is text and stays. Null texts are one empty line; turns of equal number follow each other
    in order of text; a null turn counts as 0, a null conv_id is a conversation.
    """
    held = segments(turns)
    model = model or train(held)
    kind = turns.schema["conv_id"].dataType.simpleString()

    def score(batches):
        for batch in batches:
            found = []
            for rows in batch.column("rows").to_pylist():
                units = _units([x["text"] for x in rows])
                found.append((matrix(model, units).ravel().tolist(), _from_start(model, units).tolist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("segment"), pa.array([x[0] for x in found], pa.list_(pa.float64())), pa.array([x[1] for x in found], pa.list_(pa.float64()))],
                names=["conv_id", "segment", "m", "first"],
            )

    def connect(batches):
        for batch in batches:
            out = []
            for conv, found in zip(batch.column("conv_id").to_pylist(), batch.column("found").to_pylist(), strict=True):
                ms = [np.array(x["m"]).reshape(len(ROLES), len(ROLES)) for x in found]
                out += [(conv, x["segment"], *b) for x, b in zip(found, borders(model, ms, np.array(found[0]["first"])), strict=True)]
            kinds = (batch.schema.field("conv_id").type, pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["conv", "part_of", "before", "last"])

    def render(batches):
        for batch in batches:
            out = []
            for conv, rows, before, last in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "rows", "before", "last")), strict=True):
                roles = iter(decode(model, _units([x["text"] for x in rows]), before, last))
                for x in rows:
                    parts: list[tuple[int, list[str]]] = []
                    for text, said, _, whole in lines(x["text"]):
                        role = next(roles)
                        begins = not parts or parts[-1][0] != role
                        if begins:
                            parts.append((role, []))
                        parts[-1][1].append(text if begins and said == role else whole)
                    for k, (role, texts) in enumerate(parts):
                        body = "\n".join(texts).strip()
                        out.append((conv, x["turn"], k, ROLES[role], x["role"], body, f"<|{ROLES[role]}|>\n{body}\n<|end|>"))
            kinds = (batch.schema.field("conv_id").type, pa.int64(), pa.int32(), *[pa.string()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["conv_id", "turn", "part", "role", "given", "text", "rendered"])

    scored = held.mapInArrow(score, f"conv_id {kind}, segment long, m array<double>, first array<double>")
    chains = scored.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("segment", "m", "first"))).alias("found"))
    ends = chains.mapInArrow(connect, f"conv {kind}, part_of long, before int, last int")
    joined = held.join(ends, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("segment") == F.col("part_of"))).select("conv_id", "rows", "before", "last")
    return joined.mapInArrow(render, f"conv_id {kind}, turn long, part int, role string, given string, text string, rendered string")


def _from_start(model: Model, units: list) -> np.ndarray:
    """Best score over the units from the start of a conversation to each role of the last."""
    step, emit = _paths(model, units)
    best = model.start + emit[0]
    for k in range(1, len(units)):
        best = (best[:, None] + step[k]).max(axis=0) + emit[k]
    return best


def op5_transcripts(spark, sf_dir: str) -> DataFrame:
    """Canonical turns of all conversations, with the recovered and the given role."""
    return parse(table(spark, sf_dir, "conversations"))
