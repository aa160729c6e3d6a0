"""Chat formatting: a hidden Markov model recovers the turns and roles of raw transcripts, which are then rendered alike."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, staged

ROLES = ("system", "user", "assistant")
#: A line begins a turn of a role (even) or goes on with it (odd).
STATES = [(role, part) for role in ROLES for part in ("begin", "inside")]
# The names that speaker markers use for each role.
NAMES = {
    "system": ("system", "context", "setup"),
    "user": ("user", "human", "customer", "question", "q", "instruction", "prompt"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "a", "response", "model"),
}
ROLE_OF = {name: role for role, names in NAMES.items() for name in names}
#: "Name:", "### Name", "[Name]", "<name>" or "**Name:**" at the start of a line, and what follows.
MARKER = re.compile(r"\s*(?:#{1,4}\s*(?P<h>[A-Za-z]\w{0,19})\s*:?\s*$|\[(?P<b>[A-Za-z]\w{0,19})\]:?\s?|<\|?(?P<x>[A-Za-z]\w{0,19})\|?>\s?|\*\*(?P<s>[A-Za-z]\w{0,19}):?\*\*:?\s?|(?P<c>[A-Za-z]\w{0,19}):(?:\s|$))(?P<rest>.*)", re.S)
MARKS = ("none", *ROLES, "other")
FEATURES = {"mark": len(MARKS), "gap": 2, "ask": 2, "size": 6}


def read_marker(line: str) -> tuple[int, str]:
    """(index in MARKS, text after the marker). A name that stands for no role is 'other' and stays in the text."""
    m = MARKER.match(line)
    if not m:
        return 0, line
    name = next(v for k, v in m.groupdict().items() if v is not None and k != "rest").lower()
    role = ROLE_OF.get(name)
    return (MARKS.index(role), m["rest"]) if role else (len(MARKS) - 1, line)


def line_features(lines: list[str], gap: bool = True) -> np.ndarray:
    """FEATURES of each line: its marker, whether it comes after a blank line or first, a question mark at its end, its size. gap:
    that of the first line, if it is not the first of its transcript."""
    out = np.zeros((len(lines), len(FEATURES)), np.int64)
    for i, line in enumerate(lines):
        out[i] = (read_marker(line)[0], not lines[i - 1].strip() if i else gap, line.rstrip().endswith("?"), min(5, len(line).bit_length() // 2))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[int, int, int], int] = {}
    add = lambda kind, a, b: counts.__setitem__((kind, a, b), counts.get((kind, a, b), 0) + 1)
    for batch in batches:
        for turns in batch.column(0).to_pylist():
            lines, states = [], []
            for t in turns or []:
                own = (t["raw"] or "").split("\n")
                lines += own
                states += [2 * ROLES.index(t["role"]) + (k > 0) for k in range(len(own))]
            if not lines:
                continue
            add(0, 0, states[0])
            for a, b in zip(states, states[1:]):
                add(1, a, b)
            for s, row in zip(states, line_features(lines).tolist()):
                for k, v in enumerate(row):
                    add(2 + k, s, v)
    keys = sorted(counts)
    yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int64()) for i in range(3)] + [pa.array([counts[k] for k in keys], pa.int64())], names=["kind", "a", "b", "n"])


class Model:
    """Log probabilities: of the first state, of each step, and of each feature value in each state; counts smoothed by 0.5."""

    def __init__(self, counts: dict[tuple[int, int, int], int]):
        s = len(STATES)
        self.start = np.full(s, 0.5)
        self.step = np.full((s, s), 0.5)
        self.emit = [np.full((s, n), 0.5) for n in FEATURES.values()]
        for (kind, a, b), n in counts.items():
            if kind == 0:
                self.start[b] += n
            elif kind == 1:
                self.step[a, b] += n
            else:
                self.emit[kind - 2][a, b] += n
        self.start[1::2] = 1e-9
        for a in range(s):
            for b in range(1, s, 2):  # a role goes on only within its own turn
                if a // 2 != b // 2:
                    self.step[a, b] = 1e-9
        self.start = np.log(self.start / self.start.sum())
        self.step = np.log(self.step / self.step.sum(1, keepdims=True))
        self.emit = [np.log(e / e.sum(1, keepdims=True)) for e in self.emit]

    def emission(self, features: np.ndarray) -> np.ndarray:
        return sum(t[:, features[:, k]].T for k, t in enumerate(self.emit))

    def viterbi(self, features: np.ndarray, before: int = -1, last: int = -1) -> list[int]:
        """The most likely states of the lines; of equal ones the first. before: the state of the line ahead of them, -1 at the
        start of a transcript; last: the state that they end in, -1 if it is open."""
        e = self.emission(features)
        best, back = (self.start if before < 0 else self.step[before]) + e[0], []
        for row in e[1:]:
            all_ = best[:, None] + self.step
            back.append(all_.argmax(0))
            best = all_.max(0) + row
        out = [int(best.argmax()) if last < 0 else last]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]

    def transfer(self, features: np.ndarray, first: bool) -> np.ndarray:
        """The best log probability of the lines from each state ahead of them (from the start: one row for all) to each state
        that they end in. Such tables of consecutive parts are multiplied as (max, +) matrices."""
        e = self.emission(features)
        best = (np.tile(self.start, (len(STATES), 1)) if first else self.step) + e[0]
        for row in e[1:]:
            best = (best[:, :, None] + self.step[None]).max(1) + row
        return best

    def parse(self, text: str, before: int = -1, last: int = -1, gap: bool = True) -> tuple[list[dict], bool]:
        """Turns (role, content) of a transcript or a part of one, and whether the first of them goes on with the turn of the part
        before. A blank line at the end of a turn is dropped. No text, no turns."""
        if before < 0 and not text.strip():
            return [], False
        lines = text.split("\n")
        turns: list[tuple[str, list[str]]] = []
        states = self.viterbi(line_features(lines, gap), before, last)
        for state, line in zip(states, lines):
            role, part = STATES[state]
            if part == "begin" or not turns:
                turns.append((role, [read_marker(line)[1] if part == "begin" else line]))
            else:
                turns[-1][1].append(line)
        return [{"role": role, "content": "\n".join(own).strip("\n")} for role, own in turns], before >= 0 and states[0] % 2 == 1


def render(turns: list[dict]) -> str:
    """The canonical form: a line with the role, the content, and a line that closes the turn."""
    return "".join(f"<|{t['role']}|>\n{t['content']}\n<|end|>\n" for t in turns)


def train_parser(examples: DataFrame, turns_col: str = "turns") -> Model:
    """A Model from transcripts with known turns, an array of (role, raw) where raw is the turn as it stands in the transcript,
    marker included. Turns of all examples are counted; the counts have a fixed size. Examples with a role outside ROLES are
    left out; without any example the model has its smoothing alone."""
    known = examples.where(F.col(turns_col).isNotNull() & F.forall(turns_col, lambda t: F.coalesce(t["role"].isin(*ROLES), F.lit(False))))
    counts = known.select(turns_col).mapInArrow(_count, "kind long, a long, b long, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    return Model({(r["kind"], r["a"], r["b"]): r["n"] for r in counts.collect()})


def _parse(model: Model):
    """Columns src, before, last, gap and text to src, turns, rendered and continues."""
    kind = pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.parse(t or "", b, z, g) for b, z, g, t in zip(*(c.to_pylist() for c in batch.columns[1:]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in found], kind), pa.array([render(t) for t, _ in found], pa.string()), pa.array([c for _, c in found], pa.bool_())], names=["src", "turns", "rendered", "continues"])

    return run


def _transfers(model: Model):
    """For each part its transfer table after a blank line, after another one, and from the start, and whether it ends with a blank line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables, blank = [], []
            for text in batch.column(2).to_pylist():
                lines = (text or "").split("\n")
                tables.append(np.concatenate([model.transfer(line_features(lines, gap), first).ravel() for gap, first in ((True, False), (False, False), (True, True))]).tolist())
                blank.append(not lines[-1].strip())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tables, pa.list_(pa.float64())), pa.array(blank)], names=["conv", "part", "tables", "blank"])

    return run


def _chained(key: tuple, table: pa.Table) -> pa.Table:
    """For each part of a conversation the state ahead of it, the state that it ends in, and whether a blank line is ahead."""
    table, s = table.sort_by("part"), len(STATES)
    tables = np.array(table.column("tables").to_pylist()).reshape(-1, 3, s, s)
    blank = [True, *table.column("blank").to_pylist()[:-1]]
    own = tables[np.arange(len(tables)), [2, *(0 if b else 1 for b in blank[1:])]]
    ends = [own[0][0]]  # the rows of a table from the start are alike
    for m in own[1:]:
        ends.append((ends[-1][:, None] + m).max(0))
    last = [int(ends[-1].argmax())]
    for k in range(len(own) - 1, 0, -1):
        last.append(int((ends[k - 1] + own[k][:, last[-1]]).argmax()))
    last = last[::-1]
    return pa.table({"conv": table.column("conv"), "part": table.column("part"), "before": pa.array([-1, *last[:-1]], pa.int32()), "last": pa.array(last, pa.int32()), "gap": pa.array(blank)})


def parse_transcripts(transcripts: DataFrame, model: Model, keep: list[str], text_col: str = "transcript", parts_of: tuple[str, str] | None = None) -> DataFrame:
    """The columns in keep, turns (array of role and content), rendered and continues for each transcript, a row each.

    parts_of: the columns of a conversation and of the number of a row's part of it, 0 if it has only one. The parts of a conversation are
    parsed as one transcript: each gives the (max, +) matrix of its lines, a chain over these (108 numbers a part) finds the
    states at the cuts, and each part is decoded between them, which is Viterbi's path of the whole. `continues` marks a part
    whose first turn goes on with the last one of the part before.

    Null, empty and blank transcripts have no turns. Repeated rows are parsed alike; an empty table gives an empty result.
    Columns named turns, rendered or continues give way to the new ones.
    """
    cols = [c for c in keep if c not in ("turns", "rendered", "continues")]
    place = [F.col(c) for c in parts_of] if parts_of else [F.lit(None).cast("string"), F.lit(0)]
    src = transcripts.select(F.struct(*(F.col(c) for c in cols)).alias("src"), place[0].cast("string").alias("conv"), place[1].cast("long").alias("part"), F.col(text_col).alias("text"))
    whole = src.withColumns({"before": F.lit(-1), "last": F.lit(-1), "gap": F.lit(True)})
    if parts_of and not src.where("part <> 0").isEmpty():
        cut = src.where("part <> 0").select("conv").distinct()
        some = src.join(cut, src["conv"].eqNullSafe(cut["conv"]), "left_semi")
        tables = staged(some.select("conv", "part", "text").distinct().mapInArrow(_transfers(model), "conv string, part long, tables array<double>, blank boolean"), "transfers")
        chain = staged(tables.groupBy("conv").applyInArrow(_chained, "conv string, part long, before int, last int, gap boolean"), "chain")
        dropped(tables)
        c = chain.select(F.col("conv").alias("c"), F.col("part").alias("p"), "before", "last", "gap")
        whole = src.join(c, src["conv"].eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left").select(*src.columns, F.coalesce("before", F.lit(-1)).alias("before"), F.coalesce("last", F.lit(-1)).alias("last"), F.coalesce("gap", F.lit(True)).alias("gap"))
    turns = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
    out = whole.select("src", "before", "last", "gap", "text").mapInArrow(_parse(model), T.StructType([src.schema["src"], T.StructField("turns", turns), T.StructField("rendered", T.StringType()), T.StructField("continues", T.BooleanType())]))
    return out.select(*(F.col("src")[c].alias(c) for c in cols), "turns", "rendered", "continues")


def transcripts_of(conversations: DataFrame, chunk: int = 256, bare_every: int = 12) -> DataFrame:
    """Raw transcripts from rows (conv_id, turn, role, text): conv_id, part, turns (role, raw) and transcript.

    The speaker markers of a conversation are of one of four styles by its id; about one turn in bare_every (never the first)
    has a blank line in place of its marker. A part holds at most `chunk` turn numbers, so a conversation without end is not
    gathered in one task; parse_transcripts(parts_of=...) parses the parts as one transcript. Null text is empty; roles are
    human or user, system, and assistant for any other; repeated rows count once; rows without a turn number come first, in
    1024 parts below 0 by hash of the text.
    """
    role = F.lower(F.coalesce("role", F.lit("")))
    role = F.when(role.isin("user", "human"), "user").when(role == "system", "system").otherwise("assistant")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    style = F.pmod(F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit(""))), F.lit(4))
    bare = (F.pmod(F.crc32(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))), F.lit(bare_every)) == 0) & (F.col("turn") > 0)
    name = F.initcap("role")
    other = F.when(F.col("role") == "user", "Human").when(F.col("role") == "system", "System").otherwise("AI")
    bare = F.coalesce(bare, F.lit(False))
    mark = F.when(bare, "\n").when(style == 0, F.concat(name, F.lit(": "))).when(style == 1, F.concat(other, F.lit(": "))).when(style == 2, F.concat(F.lit("### "), name, F.lit("\n"))).otherwise(F.concat(F.lit("["), F.upper("role"), F.lit("] ")))
    part = F.coalesce(F.floor(F.col("turn") / chunk), -1 - F.pmod(F.xxhash64("text"), F.lit(1024))).alias("part")
    turns = rows.groupBy("conv_id", part).agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.concat(mark, F.col("text")).alias("raw")))).alias("t"))
    return turns.select("conv_id", "part", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["raw"].alias("raw"))).alias("turns"), F.array_join(F.transform("t", lambda t: t["raw"]), "\n").alias("transcript"))
