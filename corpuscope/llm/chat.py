"""Transcript parsing: roles are recovered by a hidden Markov model over lines, then turns are rendered in one canonical form.

A line's state is a role and whether it begins a turn. What is seen of a line is its speaker marker's kind, whether a blank line comes before it,
whether it asks, and its length. Counts over labelled transcripts give the model; Viterbi gives the states. The registered query fits two models,
each on half of the transcripts, and parses every transcript by the model that hasn't seen it.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

ROLES = ("system", "user", "assistant")
STATES = len(ROLES) * 2  # role * 2, + 1 inside a turn
_NAMES = {
    "system": "system|system prompt|instructions?|context|developer|sys",
    "user": "user|human|customer|client|question|prompter|you|q|u|h",
    "assistant": "assistant|ai|bot|agent|chatbot|model|answer|response|support|gpt|a|b",
}
_ANY = "|".join(f"(?P<{r}>{n})" for r, n in _NAMES.items())
#: Markers: chat tokens and brackets, headings, and names before a colon. They take up the line's start, or all of it.
_MARKERS = [re.compile(p) for p in (rf"(?i)^\s*<\|?(?:im_start\|?>)?\s*(?:{_ANY})\s*(?:\|?>)?[ \t]*:?[ \t]*", rf"(?i)^\s*\[\s*(?:{_ANY})\s*\][ \t]*:?[ \t]*", rf"(?i)^\s*#{{1,6}}[ \t]*(?:{_ANY})[ \t]*:?[ \t]*$", rf"(?i)^\s*\*\*(?:{_ANY}):?\*\*[ \t]*:?[ \t]*", rf"(?i)^\s*(?:{_ANY})[ \t]*(?:\(\d[\d:. apm]*\))?[ \t]*:[ \t]*")]
_END = re.compile(r"(?i)[ \t]*<\|(?:im_)?end(?:_of_turn|oftext)?\|>[ \t]*$")
KINDS = 1 + len(ROLES)
SYMBOLS = KINDS * 2 * 2 * 3


def marker(line: str) -> tuple[int, int]:
    """The marker's kind (0: none, else 1 + role), and where the line's text begins."""
    for p in _MARKERS:
        m = p.match(line)
        if m:
            return 1 + next(k for k, r in enumerate(ROLES) if m.group(r)), m.end()
    return 0, 0


def observe(lines: list[str]) -> tuple[np.ndarray, list[int]]:
    """A symbol for each line, and where its text begins."""
    out, begins, blank = [], [], True
    for s in lines:
        kind, begin = marker(s)
        size = len(s) - begin
        out.append(((kind * 2 + blank) * 2 + ("?" in s)) * 3 + (0 if size == 0 else 1 if size < 120 else 2))
        begins.append(begin)
        blank = not s.strip()
    return np.array(out, np.int64), begins


def _allowed() -> np.ndarray:
    """A line inside a turn follows one of the same role."""
    ok = np.zeros((STATES, STATES), bool)
    ok[:, ::2] = True
    for r in range(len(ROLES)):
        ok[2 * r, 2 * r + 1] = ok[2 * r + 1, 2 * r + 1] = True
    return ok


class Model:
    """Log probabilities from counts of starts (S), steps (S, S) and symbols (S, V), each with a small prior."""

    def __init__(self, start: np.ndarray, step: np.ndarray, seen: np.ndarray):
        ok = _allowed()
        first = np.zeros(STATES, bool)
        first[::2] = True
        # a marker names its role, whatever the counts say
        prior = np.full((STATES, KINDS, SYMBOLS // KINDS), 0.02)
        for r in range(len(ROLES)):
            prior[2 * r, 1 + r] = 2.0
            prior[2 * r + 1, 0] = 2.0
        seen = seen + prior.reshape(STATES, SYMBOLS)
        with np.errstate(divide="ignore"):
            self.start = np.log(np.where(first, start + 1.0, 0) / (start + 1.0)[first].sum())
            self.step = np.log(np.where(ok, step + 1.0, 0) / np.where(ok, step + 1.0, 0).sum(1, keepdims=True))
        self.seen = np.log(seen / seen.sum(1, keepdims=True))

    def viterbi(self, many: list[np.ndarray]) -> list[np.ndarray]:
        """The most probable states of each sequence of symbols; all sequences side by side, the longest first."""
        order = sorted(range(len(many)), key=lambda i: -len(many[i]))
        out = [np.zeros(0, np.int64)] * len(many)
        order = [i for i in order if len(many[i])]
        if not order:
            return out
        size = np.array([len(many[i]) for i in order])
        score = self.start + self.seen[:, [many[i][0] for i in order]].T
        back: list[np.ndarray] = []
        for t in range(1, int(size[0])):
            n = int(np.searchsorted(-size, -t))  # sequences longer than t
            best = score[:n, :, None] + self.step
            back.append(best.argmax(1))
            score[:n] = best.max(1) + self.seen[:, [many[i][t] for i in order[:n]]].T
        state = score.argmax(1)
        paths = [np.zeros(k, np.int64) for k in size]
        for t in range(int(size[0]) - 1, -1, -1):
            n = int(np.searchsorted(-size, -t))
            for k in range(n):
                paths[k][t] = state[k]
            if t:
                rows = np.arange(n)
                state[:n] = back[t - 1][rows, state[:n]]
        for k, i in enumerate(order):
            out[i] = paths[k]
        return out


def parse(text: str, model: Model, states: np.ndarray | None = None, lines: list[str] | None = None) -> list[tuple[str, str]]:
    """Turns (role, text) of a transcript."""
    lines = text.split("\n") if lines is None else lines
    symbols, begins = observe(lines)
    states = model.viterbi([symbols])[0] if states is None else states
    turns: list[tuple[str, list[str]]] = []
    for s, begin, line in zip(states.tolist(), begins, lines):
        role = ROLES[s // 2]
        if s % 2 == 0 and (begin or line.strip() or not turns):
            turns.append((role, []))
            turns[-1][1].append(_END.sub("", line[begin:]))
        else:
            turns[-1][1].append(_END.sub("", line))
    return [(r, "\n".join(ls).strip()) for r, ls in turns]


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in turns)


#: Ways in which transcripts mark speakers: by role, before and between.
STYLES = [
    ({"system": "System: ", "user": "User: ", "assistant": "Assistant: "}, "\n"),
    ({"system": "Instructions: ", "user": "Human: ", "assistant": "AI: "}, "\n\n"),
    ({"system": "### System\n", "user": "### User\n", "assistant": "### Assistant\n"}, "\n\n"),
    ({"system": "<|system|>\n", "user": "<|user|>\n", "assistant": "<|assistant|>\n"}, "\n"),
    ({"system": "[system] ", "user": "[user] ", "assistant": "[assistant] "}, "\n"),
    ({"system": "Context: ", "user": "Q: ", "assistant": "A: "}, "\n\n"),
    ({"system": "", "user": "", "assistant": "**Bot:** "}, "\n\n"),  # only one side is marked
]


def transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id, transcript, and states (of its lines): turns in order, written in the style that the id's hash picks.

    Rows with a null conv_id are left out; ids must be integers. Rows are in order of turn (null ones first), role and text; repeated ones are all there. A null text is an
    empty turn; a null or other role is taken for the user's.
    """
    role = F.when(F.lower("role").isin(*ROLES), F.lower("role")).otherwise("user")
    d = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    d = d.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts")).withColumn("style", F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("int"))

    def write(batches):
        for b in batches:
            ids, texts, states = [], [], []
            for i, ts, style in zip(*(b.column(c).to_pylist() for c in range(3))):
                marks, between = STYLES[style]
                lines, own = [], []
                for k, t in enumerate(ts):
                    if k:
                        for _ in between[1:]:
                            lines.append("")
                            own.append(own[-1] | 1)
                    new = (marks[t["role"]] + t["text"]).split("\n")
                    lines += new
                    own += [2 * ROLES.index(t["role"]) + (j > 0) for j in range(len(new))]
                ids.append(i)
                texts.append("\n".join(lines))
                states.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts), pa.array(states, pa.list_(pa.int32()))], names=["conv_id", "transcript", "states"])

    return d.mapInArrow(write, "conv_id long, transcript string, states array<int>")


def fit(labelled: DataFrame) -> Model:
    """The model from all labelled transcripts (transcript, states). Rows with a null in either, or of unequal lengths, don't count; with no rows the prior decides."""

    def count(batches):
        start, step, seen = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, SYMBOLS))
        for b in batches:
            for text, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text is None or s is None or not s:
                    continue
                x, s = observe(text.split("\n"))[0], np.array(s)
                if len(x) != len(s):
                    continue
                start[s[0]] += 1
                np.add.at(step, (s[:-1], s[1:]), 1)
                np.add.at(seen, (s, x), 1)
        for name, a in (("start", start), ("step", step), ("seen", seen)):
            at = np.flatnonzero(a)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(a.reshape(-1)[at])], names=["what", "at", "n"])

    got = labelled.select("transcript", "states").mapInArrow(count, "what string, at int, n double").groupBy("what", "at").agg(F.sum("n").alias("n")).collect()
    a = {"start": np.zeros(STATES), "step": np.zeros(STATES * STATES), "seen": np.zeros(STATES * SYMBOLS)}
    for r in got:
        a[r["what"]][r["at"]] = r["n"]
    return Model(a["start"], a["step"].reshape(STATES, STATES), a["seen"].reshape(STATES, SYMBOLS))


def format_chats(raw: DataFrame, model: Model, *, id_col: str = "conv_id", text_col: str = "transcript") -> DataFrame:
    """id_col, turns (number), roles (of the turns, by commas) and chat (the canonical rendering).

    A null or empty transcript has 0 turns, empty roles and an empty chat. Ids may be null or repeated; each row is parsed by its text alone. Whole
    transcripts are parsed, whatever their length. Of paths of states with equal weights that with the states of the smaller numbers is taken. An empty table gives no rows. Other columns are not looked at.
    """
    kind = dict(raw.dtypes)[id_col]

    def run(batches):
        for b in batches:
            lines = [t.split("\n") if t else [] for t in b.column(1).to_pylist()]
            states = model.viterbi([observe(x)[0] for x in lines])
            turns = [parse("", model, s, x) if x else [] for s, x in zip(states, lines)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in turns], pa.int32()), pa.array([",".join(r for r, _ in t) for t in turns]), pa.array([render(t) for t in turns])], names=[id_col, "turns", "roles", "chat"])

    return raw.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, turns int, roles string, chat string")


#: Parts of the transcripts; each is parsed by a model of the others.
FOLDS = 2


def parse_held_out(raw: DataFrame) -> DataFrame:
    """format_chats() of labelled transcripts (conv_id, transcript, states), each by a model that is fitted on the folds that it isn't in; folds go by a hash of the id."""
    raw = checkpointed(raw.withColumn("fold", F.pmod(F.xxhash64("conv_id", F.lit("fold")), F.lit(FOLDS))))
    parts = [format_chats(raw.where(F.col("fold") == k), fit(raw.where(F.col("fold") != k))) for k in range(FOLDS)]
    return reduce(DataFrame.unionAll, parts)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_held_out(transcripts(table(spark, sf_dir, "conversations")))
