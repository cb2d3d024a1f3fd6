"""Chat formatting: a hidden Markov model recovers who speaks in a transcript, line by line.

A state is a role together with whether the line begins a turn. What a line shows is a speaker
marker at its start, its length and whether it asks. Lengths, questions, turn lengths and the order
of roles are counted from turns with known roles; how often markers are right or missing is given.

A conversation can be of any length. Its turns are put in order by ranges, written and cut into segments by their
numbers in the written table, so that no task gathers a conversation; and each segment is one
max-plus matrix: the best score from any state before it to any state at its end. The matrices of a
conversation are chained, which gives the state at each cut, and then every segment is decoded by
Viterbi on its own between its two states. That is the best path of the whole conversation. Parts of
turns at the cuts are joined before they are rendered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitledger.llm.common import ship, written

ROLES = ("system", "user", "assistant")
STATES = tuple((role, begins) for role in range(3) for begins in (True, False))
SEGMENT = 128  # turns
SORTED_TEXT = 100  # characters of a text that part turns with one number

#: Fixed: how speakers are called, by role, in lower case.
SPEAKERS = {
    "system": "system sys instructions context".split(),
    "user": "user human inst customer client question q prompt me you student utilisateur benutzer usuario".split(),
    "assistant": "assistant ai bot chatbot gpt model answer a response agent asistente assistent".split(),
}
ROLE_OF = {name: role for role, names in enumerate(SPEAKERS.values()) for name in names}
MARKER = re.compile(r"\s{0,3}(?:#{1,6} {0,2}|\*{1,2}|<\|(?:im_start\|>)?|\[)?([^\W\d_][\w .'-]{0,30}?)(?:\*{0,2}:\*{0,2}|\|>|\]:?|(?<=[a-z])$)(?: |$)?", re.ASCII | re.IGNORECASE)
CLOSER = re.compile(r"(?:<\|(?:im_)?end\|>|</s>)\s*$")
NAME = 3  # a marker of somebody unknown
NONE = 4
LENGTHS = (1, 40, 120, 400)
LOOKS = 2 * (len(LENGTHS) + 1)

#: P(marker | state), given: own role, another role, a name, none; for lines that begin a turn and others.
BEGINS_MARKED = (0.70, 0.005, 0.05, 0.24)
INSIDE_MARKED = (0.002, 0.001, 0.01, 0.985)


def read_line(line: str) -> tuple[int, int, str]:
    """Marker (role, NAME or NONE), look, and the line without marker and closer."""
    marker, text = NONE, CLOSER.sub("", line)
    found = MARKER.match(text)
    if found:
        name, bare = found[1].strip().lower(), found.end() == found.end(1)
        if name in ROLE_OF and not (bare and len(name) < 4):
            marker, text = ROLE_OF[name], text[found.end() :]
        elif not bare and found[1][:1].isupper() and len(name.split()) <= 3 and found[0].rstrip()[-1:] == ":":
            marker = NAME  # the name stays: it may be text
    size = len(text.strip())
    return marker, 2 * sum(size >= x for x in LENGTHS) + text.rstrip().endswith("?"), text


def lines_of(text: str) -> list[tuple[int, int, str]]:
    return [read_line(x) for x in text.split("\n")]


class RoleModel:
    """Log probabilities: start [state], step [state, state], show [marker, look, state]."""

    def __init__(self, looks: np.ndarray, more_lines: np.ndarray, follows: np.ndarray, starts: np.ndarray):
        looks = (looks + 0.5) / (looks + 0.5).sum(1, keepdims=True)
        go_on = (more_lines[:, 1] + 1) / (more_lines.sum(1) + 2)
        follows = (follows + 0.1) / (follows + 0.1).sum(1, keepdims=True)
        starts = (starts + 0.1) / (starts + 0.1).sum()
        step, start = np.zeros((6, 6)), np.zeros(6)
        show = np.zeros((5, LOOKS, 6))
        for i, (role, begins) in enumerate(STATES):
            start[i] = starts[role] if begins else 1e-9
            for j, (other, new) in enumerate(STATES):
                step[i, j] = (1 - go_on[role]) * follows[role, other] if new else go_on[role] * (role == other)
            own, wrong, name, none = BEGINS_MARKED if begins else INSIDE_MARKED
            for marker in range(5):
                p = none if marker == NONE else name if marker == NAME else own if marker == role else wrong
                show[marker, :, i] = p * looks[i]
        self.start, self.step, self.show = (np.log(np.maximum(x, 1e-12)) for x in (start, step, show))

    @classmethod
    def fit(cls, turns: DataFrame) -> RoleModel:
        """Counts over all turns (conv_id, turn, role, text) whose role is one of ROLES."""
        role = F.array_position(F.array(*map(F.lit, ROLES)), F.lower("role")).cast("int") - 1
        known = turns.select("conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("role >= 0")
        line = F.posexplode(F.split("text", "\n", -1)).alias("at", "line")
        size = F.length(F.trim("line"))
        longer = sum((size >= x).cast("int") for x in LENGTHS)
        look = 2 * longer + F.endswith(F.rtrim("line"), F.lit("?")).cast("int")
        looks, more, follows, starts = np.zeros((6, LOOKS)), np.zeros((3, 2)), np.zeros((3, 3)), np.zeros(3)
        shown = known.select("role", line).select((2 * F.col("role") + (F.col("at") > 0).cast("int")).alias("state"), look.alias("look"))
        for r in shown.groupBy("state", "look").count().collect():  # at most 6 by LOOKS rows
            looks[r.state, r.look] = r["count"]
        for r in known.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.size(F.split("text", "\n", -1)) - 1).alias("more")).collect():
            more[r.role] = r.n, r.more
        before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
        for r in known.select("role", before.alias("before")).groupBy("role", "before").count().collect():  # at most 12 rows
            if r.before is None:
                starts[r.role] = r["count"]
            else:
                follows[r.before, r.role] = r["count"]
        return cls(looks, more, follows, starts)

    def matrix(self, seen: list[tuple[int, int]]) -> np.ndarray:
        """Best scores from each state before these lines to each state at the last of them."""
        best = np.where(np.eye(6, dtype=bool), 0.0, -np.inf)
        for marker, look in seen:
            best = (best[:, :, None] + self.step).max(1) + self.show[marker, look]
        return best

    def decode(self, seen: list[tuple[int, int]], entry: int, exit_: int) -> list[int]:
        """The best states of these lines between the state before and the state of the last line.

        An entry of -1 is the start of the conversation.
        """
        score = self.start if entry < 0 else self.step[entry]
        back = []
        for k, (marker, look) in enumerate(seen):
            if k:
                ways = score[:, None] + self.step
                back.append(ways.argmax(0))
                score = ways.max(0)
            score = score + self.show[marker, look]
        path = [exit_]
        for ways in reversed(back):
            path.append(int(ways[path[-1]]))
        return path[::-1] if seen else []

    def opening(self, seen: list[tuple[int, int]]) -> np.ndarray:
        """Best scores from the start of the conversation to each state at the last of these lines."""
        first, *rest = seen
        score = self.start + self.show[first]
        return (score[:, None] + self.matrix(rest)).max(0)


def _lines(turns: list[dict]) -> list[tuple[int, int, str, int]]:
    return [(*x, t["turn"]) for t in turns for x in lines_of(t["text"])]


def _matrices(model: RoleModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for turns in batch.column("turns"):
                seen = [x[:2] for x in _lines(turns.as_py())]
                out.append([*model.opening(seen), *model.matrix(seen).ravel()])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("segment"), pa.array(out, pa.list_(pa.float64()))], ["conv_id", "segment", "scores"])

    return run


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over segments sorted by conversation: the states before and at the end of each, and whether
    more segments follow."""
    names = ["conv_id", "segment", "entry", "last", "more"]

    def conversation(conv: str | None, held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        alphas, score = [], None
        for _, scores in held:
            score = scores[:6] if score is None else (score[:, None] + scores[6:].reshape(6, 6)).max(0)
            alphas.append(score)
        at, rows = int(alphas[-1].argmax()), []
        for k in range(len(held) - 1, -1, -1):
            entry = int((alphas[k - 1] + held[k][1][6:].reshape(6, 6)[:, at]).argmax()) if k else -1
            rows.append((conv, held[k][0], entry, at, k + 1 < len(held)))
            at = entry
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()))], names)

    held, last = [], None
    for batch in batches:
        for conv, segment, scores in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if held and conv != last:
                yield conversation(last, held)
                held = []
            last = conv
            held.append((segment, np.array(scores)))
    if held:
        yield conversation(last, held)


TURNS = "conv_id string, turn long, continues boolean, role string, n_lines long, rendered string"
PARTS = "conv_id string, segment long, at long, starts boolean, turn long, continues boolean, role string, n_lines long, body string"


def render(role: str, text: str) -> str:
    """One canonical turn."""
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def _decode(model: RoleModel, at_cuts: bool):
    """The turns that lie within segments, or the parts of turns that a cut can divide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, segment, turns, entry, last, more in zip(*(batch.column(k).to_pylist() for k in range(6))):
                lines, at = _lines(turns), 0
                states = model.decode([x[:2] for x in lines], entry, last)
                begins = [k for k, s in enumerate(states) if STATES[s][1] or k == 0]
                for at, end in zip(begins, [*begins[1:], len(lines)]):
                    role, new = STATES[states[at]]
                    starts = new or at > 0 or entry < 0
                    if at_cuts != (not starts or (more and end == len(lines))):
                        continue
                    body = "\n".join(x[2].rstrip() for x in lines[at:end])
                    if at_cuts:
                        out.append((conv, segment, at, starts, lines[at][3], not new, ROLES[role], end - at, body))
                    else:
                        out.append((conv, lines[at][3], not new, ROLES[role], end - at, render(ROLES[role], body.strip())))
            yield _batch(out, PARTS if at_cuts else TURNS)

    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    of = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, of[k]) for x, k in zip(columns, kinds)], list(names))


def _join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over the parts of each turn in order: whole turns."""
    for batch in batches:
        out = []
        for conv, parts in zip(*(batch.column(k).to_pylist() for k in range(2))):
            head = parts[0]
            body = "\n".join(x["body"] for x in parts).strip()
            out.append((conv, head["turn"], head["continues"], head["role"], sum(x["n_lines"] for x in parts), render(head["role"], body)))
        yield _batch(out, TURNS)


def _segments(segment: int):
    """Over turns in order: those of a conversation, in rows of `segment` turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(done: list[tuple]) -> pa.RecordBatch:
            conv, number, turns = zip(*done)
            return pa.RecordBatch.from_arrays([pa.array(conv, pa.string()), pa.array(number, pa.int64()), pa.array(turns, kind)], ["conv_id", "segment", "turns"])

        kind = pa.list_(pa.struct([("turn", pa.int64()), ("text", pa.string())]))
        last, held = None, []
        for batch in batches:
            done = []
            for conv, turn, text, place in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if held and (conv != last[0] or len(held) == segment):
                    done.append((*last, held))
                    held = []
                if not held:
                    last = (conv, place)
                held.append({"turn": turn, "text": text})
            if done:
                yield rows(done)
        if held:
            yield rows([(*last, held)])

    return run


def parse_transcripts(parts: DataFrame, model: RoleModel, segment: int = SEGMENT) -> DataFrame:
    """One row per recovered turn: conv_id, turn, continues, role, n_lines, rendered.

    parts has conv_id of any simple type, turn (the order) and text, of any number of lines, without
    roles. turn is that of the first line. A turn that goes on over cuts between segments is one row; continues
    marks a conversation whose first line goes on with a turn from before it. Null texts are one empty line; null turns come first, ties
    by text; null conversations are one conversation. Closing marks and markers of known speakers
    are not part of the text. A conversation's turns, equal and null numbers among them, are dealt to
    ranges of (conversation, turn, first SORTED_TEXT characters).
    """
    ship(parts.sparkSession)
    id_type = parts.schema["conv_id"].dataType
    rows = parts.select(F.col("conv_id").cast("string"), F.col("turn").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("conv_id", "turn", F.substring("text", 1, SORTED_TEXT)).sortWithinPartitions("conv_id", "turn", "text")
    numbered = dealt.withColumn("place", F.monotonically_increasing_id())
    cut = numbered.mapInArrow(_segments(segment), "conv_id string, segment long, turns array<struct<turn:long,text:string>>")
    cut = written(cut, "segments")
    matrices = cut.mapInArrow(_matrices(model), "conv_id string, segment long, scores array<double>")
    states = matrices.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(_chain, "conv_id string, segment long, entry int, last int, more boolean")
    states = written(states.withColumnRenamed("conv_id", "c").withColumnRenamed("segment", "s"), "states")

    def decoded(states: DataFrame, at_cuts: bool) -> DataFrame:
        joined = cut.join(states, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s")))
        return joined.select("conv_id", "segment", "turns", "entry", "last", "more").mapInArrow(_decode(model, at_cuts), PARTS if at_cuts else TURNS)

    whole, divided = decoded(states, False), states.where("more or entry >= 0")
    if divided.isEmpty():
        return whole.withColumn("conv_id", F.col("conv_id").cast(id_type))
    number = F.sum(F.col("starts").cast("long")).over(Window.partitionBy("conv_id").orderBy("segment", "at"))
    part = F.struct("segment", "at", "turn", "continues", "role", "n_lines", "body")
    turns = decoded(divided, True).withColumn("number", number).groupBy("conv_id", "number").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    found = whole.unionByName(turns.select("conv_id", "parts").mapInArrow(_join_parts, TURNS))
    return found.withColumn("conv_id", F.col("conv_id").cast(id_type))


def marked_parts(turns: DataFrame) -> DataFrame:
    """Turns as a transcript shows them: one style of markers for each conversation, and every fifth
    turn, by its hash, without any marker. The role is gone."""
    names = {"user": ("User: ", "### Human:\n", "<|im_start|>user\n", "Q: "), "assistant": ("Assistant: ", "### Assistant:\n", "<|im_start|>assistant\n", "A: "), "system": ("System: ", "### System:\n", "<|im_start|>system\n", "Context: ")}
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4)).cast("int") + 1
    marker = F.lit("")
    for role, shown in names.items():
        marker = F.when(F.lower("role") == role, F.element_at(F.array(*map(F.lit, shown)), style)).otherwise(marker)
    hidden = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) == 0
    text = F.concat(F.when(hidden, F.lit("")).otherwise(marker), F.coalesce("text", F.lit("")))
    return turns.select("conv_id", "turn", text.alias("text"))
