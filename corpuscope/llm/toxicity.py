"""Toxicity by a weighted finite-state pattern grammar.

A clause becomes a string of word classes. Five transducers read it one after the other, composed into one machine:
reported speech weakens what follows a verb of saying; negation, over a few words, takes an insult back; threats are
violent verbs with an intent before them or a person after them; insults
and threats count more with a target before or after them; the last one gives weights. A clause's score is that of its best
path, and a document's score the sum over its clauses. A word that no path accepts as an insult or threat scores nothing.

The classes I and M hold the words of LEXICON, and words and stems that fit() learns from labelled documents: by their log-odds, they stand much oftener in
toxic ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Word classes: I insult, M word that insults only in some uses, V violent verb, F intent, Y person spoken to, P other person, N negation, R reported speech, O any other.
LEXICON = {
    "I": "idiot idiots moron morons loser losers scum scumbag scumbags worthless pathetic disgusting imbecile imbeciles dumbass bastard bastards asshole assholes bitch bitches dimwit dimwits halfwit halfwits lowlife lowlifes vermin cretin cretins "
    "idiota idiotas imbécil imbéciles estúpido estúpida estúpidos gilipollas imbécile connard connards connasse salaud salauds abruti abrutis dummkopf schwachkopf vollidiot vollidioten arschloch drecksack",
    "M": "stupid trash clown clowns filth garbage parasite parasites degenerate degenerates ugly jerk jerks",
    "V": "kill hurt destroy strangle stab shoot murder beat burn punch crush "
    "tue tues tuer tuons buter bute égorger égorge étrangler étrangle poignarder poignarde massacrer frapper frappe tabasser tabasse détruire détruis matar mato golpear golpeo estrangular estrangulo apuñalar apuñalo destruir destruyo degollar "
    "töten töte umbringen umbringe erschlagen erschlage erwürgen erwürge erstechen ersteche abstechen verprügeln verprügle zerstören vernichten abschlachten",
    "F": "will gonna shall i'll we'll want wants going must should deserve deserves "
    "vais vas va allons allez vont veux veut voulons mérites mérite voy vamos van quiero quiere queremos mereces merece werde wirst wird werden werdet wollen wollt sollst sollte verdienst verdient",
    "Y": "you your you're youre yourself ur u tu toi te t' vous votre vos tú ti usted ustedes vosotros eres du dich dein deine deinen euch euer eure bist êtes",
    "P": "he she they them him her his their these those everyone people il elle ils elles lui leur leurs él ella ellos ellas er ihn ihm ihr ihre ihnen",
    "N": "not never no isn't aren't wasn't don't doesn't won't can't cannot nobody neither without ne n' pas jamais aucun aucune sans ni nunca jamás tampoco nadie sin nicht nie niemals kein keine keinen keinem keiner niemand weder ohne",
    "R": "said says say called calls wrote writes claimed claims told tells quoted shouted alleged reported according "
    "dit dits disait disent écrit écrivait affirme affirmait affirmé prétend prétendait déclare déclaré appelle appelé traité crié selon dijo dijeron dicen decía decían llamó llamaron escribió afirma afirmó según gritó contó "
    "sagt sagte sagten gesagt schrieb schreibt geschrieben nannte nennt genannt behauptet behauptete rief meinte erzählte laut",
}
#: Verbs that threaten by their form: a future of one's own, or with the person spoken to at the end.
OWN_FUTURE = "tuerai tuerons égorgerai étranglerai poignarderai frapperai détruirai mataré mataremos golpearé estrangularé apuñalaré destruiré matarte mataros golpearte estrangularte apuñalarte destruirte degollarte"
#: Verbs that are violent if the person spoken to comes next, and else tell of things.
ONGOING = "killing hurting destroying strangling stabbing shooting murdering beating burning punching crushing"
#: Verbs of dying threaten if the person spoken to is among the words before; "die" is a German article too, so it needs one of the words that stand before an English verb.
DYING = "die mourir mourras mourrez crever crèveras morir morirás moriréis sterben verrecken"
_DYING, _ONGOING, _OWN_FUTURE = set(DYING.split()), set(ONGOING.split()), set(OWN_FUTURE.split())
_BEFORE_DIE = set("will gonna shall should must to you'll".split())
_SECOND = set("you you'll you're youre u tu vas te vous allez tú usted ustedes du wirst sollst ihr werdet".split())
_CLITIC = set("te t' vous os dich euch".split())
_GO = set("voy vas va vamos van".split())
_ELIDED = set("n t d l j m s c qu".split())
TOXIC_FROM = 1.0
_CLASS = {w: c for c, ws in LEXICON.items() for w in ws.split()}
#: Words end where the tokeniser ends them: at anything but letters.
_TRIGGER = r"(?i)(?:^|[^\p{L}])(?:(?:will|gonna|shall|should|must|to|ll)[^\p{L}]+die|" + "|".join(sorted([w for c in "IMV" for w in LEXICON[c].split()] + [*_OWN_FUTURE, *_ONGOING, *(_DYING - {"die"})], key=len, reverse=True)) + r")(?:$|[^\p{L}])"
_CLAUSE = re.compile(r"[^.!?;\n]+")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_ALL = "IMVFYPNRO"

#: Bounds of the sample that classes are learned from: distinct labelled texts of either kind, and characters of each (bounds of training only; whole texts are scored).
TOXIC_ROWS, CLEAN_ROWS, TRAIN_CHARS = 1500, 4000, 8000
#: Characters of a stem; documents that must hold it; times that it is oftener in toxic texts at least (its lower bound, two standard errors below): for class M, and for class I.
STEM, STEM_DOCS, MEDIUM, STRONG = range(4, 9), 5, 8.0, 40.0


class Learned(NamedTuple):
    """Classes of words (ending in "$") and stems; and the mean score per word of clean texts, which long texts reach by chance."""

    units: dict[str, str]
    rate: float


NONE = Learned({}, 0.0)


def units(word: str) -> list[str]:
    """The word and its stems."""
    return [word[:k] for k in STEM if k < len(word)] + [word + "$"]

#: A transducer: start state, arcs {(state, symbol read): [(symbol written, weight, next state)]}. All states accept. "" is written for nothing.
Machine = tuple[str, dict[tuple[str, str], list[tuple[str, float, str]]]]


def _pass(states: str, symbols: str, arcs: dict) -> dict:
    """Fills in arcs that copy their symbol and keep their state."""
    return {(q, a): arcs.get((q, a), [(a, 0.0, q)]) for q in states for a in symbols}


def reported() -> Machine:
    """After a verb of saying, insults and violent verbs become weak (i, m, v)."""
    arcs: dict = {("d", "R"): [("O", 0.0, "r")]}
    arcs |= {("r", a): [(a.lower(), 0.0, "r")] for a in "IMV"} | {("r", "R"): [("O", 0.0, "r")]}
    return "d", _pass("dr", _ALL, arcs)


def negation(scope: int = 3) -> Machine:
    """A negation takes back insults and violent verbs among the next words (scope of them)."""
    states = "0" + "".join(str(k) for k in range(1, scope + 1))
    symbols = "IMVFYPNOimv"
    arcs: dict = {}
    for q in states:
        arcs[q, "N"] = [("O", 0.0, str(scope))]
        if q != "0":
            for a in symbols:
                if a != "N":
                    arcs[q, a] = [("O" if a in "IMVimv" else a, 0.0, str(int(q) - 1))]
    return "0", _pass(states, symbols, arcs)


def threat() -> Machine:
    """A violent verb is a threat (T, weak: t) with an intent before it, or it may be one if a person comes next; else it's an ordinary word.

    The second reading is a guess that only a person resolves: other words in between end that path.
    """
    symbols = "IMVFYPOimv"
    arcs: dict = {("a", "F"): [("O", 0.0, "f")], ("f", "F"): [("O", 0.0, "f")]}
    for v, t in (("V", "T"), ("v", "t")):
        arcs["a", v] = [("O", 0.0, "a"), (t, 0.0, "g")]
        arcs["f", v] = [(t, 0.0, "a")]
        arcs["g", v] = []
    for a in symbols:
        if a not in "VvF":
            arcs["g", a] = [(a, 0.0, "a")] if a in "YP" else []
    arcs["g", "F"] = []
    return "a", _pass("afg", symbols, arcs)


def target() -> Machine:
    """Marks insults and threats that have a target: before them (states y, p), or after them (the target then writes the mark * or +)."""
    symbols = "IMTYPOimt"
    arcs: dict = {}
    for q in "nypab":
        for a in symbols:
            arcs[q, a] = [("" if a == "O" else a, 0.0, q)]
        arcs[q, "Y"], arcs[q, "P"] = [("", 0.0, "y")], [("", 0.0, q if q == "y" else "p")]
        for a in "IMTimt":
            mark = {"y": "*", "p": "+"}.get(q, "")
            arcs[q, a] = [(a + mark, 0.0, q if q in "yp" else "a")]
    arcs["a", "Y"], arcs["a", "P"] = [("*", 0.0, "y")], [("+", 0.0, "p")]
    return "n", {k: v for k, v in arcs.items() if k[0] in "nypa"}


#: What the last transducer reads, and its weights.
WEIGHTS = {"I": 1.0, "M": 0.6, "T": 1.5, "i": 0.3, "m": 0.15, "t": 0.4, "*": 0.8, "+": 0.3, "": 0.0, "O": 0.0}
WEIGHTS |= {a + m: WEIGHTS[a] + WEIGHTS[m] * (0.3 if a.islower() else 1.0) for a in "IMTimt" for m in "*+"}


def weigh() -> Machine:
    return "w", {("w", a): [("", w, "w")] for a, w in WEIGHTS.items()}


def compose(a: Machine, b: Machine) -> Machine:
    """The machine that gives b what a writes. Where a writes nothing, b stays."""
    start = a[0] + b[0]
    arcs: dict = {}
    todo, seen = [(a[0], b[0])], {(a[0], b[0])}
    inputs: dict[str, list[str]] = {}
    for q, x in a[1]:
        inputs.setdefault(q, []).append(x)
    while todo:
        p, q = todo.pop()
        for x in inputs.get(p, ()):
            out = []
            for y, w, p2 in a[1][p, x]:
                for z, v, q2 in [("", 0.0, q)] if y == "" else b[1].get((q, y), []):
                    out.append((z, w + v, p2 + q2))
                    if (p2, q2) not in seen:
                        seen.add((p2, q2))
                        todo.append((p2, q2))
            arcs[p + q, x] = out
    return start, arcs


def grammar() -> Machine:
    m = reported()
    for next_one in (negation(), threat(), target(), weigh()):
        m = compose(m, next_one)
    return m


def best_path(m: Machine, symbols: str) -> float:
    """The greatest weight of a path that reads all symbols."""
    at = {m[0]: 0.0}
    for x in symbols:
        new: dict[str, float] = {}
        for q, s in at.items():
            for _, w, q2 in m[1].get((q, x), ()):
                if s + w > new.get(q2, -1e9):
                    new[q2] = s + w
        at = new
    # a guessed threat that no person followed isn't one
    return max((s for q, s in at.items() if q[2] != "g"), default=0.0)


def _class(w: str, learned: dict[str, str]) -> str:
    """Class of a word: that of LEXICON, else its own learned one, else that of its longest learned stem."""
    c = _CLASS.get(w)
    if c is None and learned:
        c = next((learned[u] for u in reversed(units(w)) if u in learned), None)
    return c or "O"


def classes(clause: str, learned: dict[str, str] = NONE.units) -> str:
    """The word classes of a clause. Elided words ("n'es", "t'égorge") are two; what a verb's form or neighbours say of intent is written as an F before it."""
    found: list[str] = []
    for w in _TOKEN.findall(clause.lower().replace("’", "'")):
        a, mark, b = w.partition("'")
        found += [a + mark, b] if mark and w not in _CLASS and a in _ELIDED else [w]
    out = []
    for k, w in enumerate(found):
        last, after = found[k - 1] if k else "", found[k + 1] if k + 1 < len(found) else ""
        c = _class(w, learned)
        if w == "a" and last in _GO:  # "voy a matar": one form of a verb
            continue
        if w in _OWN_FUTURE or c == "V" and last in _CLITIC:
            c = "FV"
        elif w in _DYING:
            c = "FV" if (_SECOND & set(found[max(0, k - 4) : k]) or w in ("mourras", "mourrez", "crèveras", "morirás", "moriréis")) and (w != "die" or last in _BEFORE_DIE) else "O"
        elif w in _ONGOING:
            c = "V" if _CLASS.get(after) == "Y" else "O"
        elif w == "dice" and after == "que":
            c = "R"
        out.append(c)
    return "".join(out)


def clauses(text: str, m: Machine, learned: dict[str, str] = NONE.units) -> list[tuple[int, int, float]]:
    """Start, end (characters) and score of every clause that scores."""
    found = []
    for c in _CLAUSE.finditer(text):
        symbols = classes(c.group(), learned)
        if "I" in symbols or "M" in symbols or "V" in symbols:
            s = best_path(m, symbols)
            if s > 0:
                found.append((c.start(), c.end(), round(s, 4)))
    return found


def trigger(learned: dict[str, str]) -> str:
    """A regular expression that every text with a clause that scores matches."""
    stems = "|".join(re.escape(u) for u in sorted(u for u in learned if not u.endswith("$")))
    words = "|".join(re.escape(u[:-1]) for u in sorted(u for u in learned if u.endswith("$")))
    out = _TRIGGER
    if stems:
        out += r"|(?i:(?:^|[^\p{L}])(?:" + stems + "))"
    if words:
        out += r"|(?i:(?:^|[^\p{L}])(?:" + words + r")(?:$|[^\p{L}]))"
    return out


def learn(texts: list[tuple[str, bool]]) -> Learned:
    """Classes from texts and whether they are toxic. A unit counts in a text twice at most, and the standard error goes by texts, so that no single text makes a class."""
    n, d = ({True: Counter(), False: Counter()} for _ in range(2))
    total = {True: 0, False: 0}
    for kind in (True, False):
        of: dict[str, list[str]] = {}  # the units of a word that can become classes
        for text, toxic in texts:
            if toxic != kind:
                continue
            own: Counter = Counter()
            for w, k in Counter(_TOKEN.findall(text.lower().replace("’", "'"))).items():
                total[kind] += k
                if w not in of:
                    of[w] = [] if w in _CLASS else units(w) if kind else [u for u in units(w) if d[True][u] >= STEM_DOCS]
                for u in of[w]:
                    own[u] += k
            for u, k in own.items():
                n[kind][u] += min(k, 2)
                d[kind][u] += 1
    found: dict[str, str] = {}
    for u in sorted(n[True], key=len):
        if d[True][u] >= STEM_DOCS and total[False]:
            odds = math.log((n[True][u] + 0.5) / total[True]) - math.log((n[False][u] + 0.5) / total[False])
            low = odds - 2 * math.sqrt(1 / (d[True][u] + 0.5) + 1 / (d[False][u] + 0.5))
            if low > math.log(MEDIUM):
                c = "I" if low > math.log(STRONG) else "M"
                stem = next((found[v] for v in reversed(units(u.rstrip("$"))) if v in found and v != u), None)
                if stem is None or stem == "M" and c == "I":  # else its stem says so already
                    found[u] = c
    m, score, clean = grammar(), 0.0, pa.array([text for text, toxic in texts if not toxic], pa.string())
    for text in clean.filter(pc.match_substring_regex(clean, trigger(found))).to_pylist():
        score += sum(c[2] for c in clauses(text, m, found))
    return Learned(found, score / max(1, total[False]))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Learned:
    """Classes learned from docs and their labels (id_col, label_col: toxic if above 0), by a sample of bounded size: of either kind the ids of the smallest hashes.

    Null ids, labels and texts, and empty texts, are no examples; an id that is labelled repeatedly is toxic if one of its labels says so; equal texts count once. With
    no toxic or no clean example nothing is learned.
    """
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg((F.max(label_col) > 0).alias("toxic_"))
    pick = lambda kind, n: own.where(F.col("toxic_") == kind).orderBy(F.xxhash64("l_id"), "l_id").limit(n)
    sample = pick(True, toxic_rows).unionAll(pick(False, clean_rows))  # bounded, so that it can be broadcast
    text = docs.select(F.col(id_col).alias("d_id"), F.substring(F.col(text_col), 1, TRAIN_CHARS).alias("t_"))
    got = text.join(F.broadcast(sample), F.col("d_id") == F.col("l_id")).where(F.length("t_") > 0).groupBy("t_").agg(F.max("toxic_").alias("toxic_")).collect()
    return learn(sorted((r.t_, r.toxic_) for r in got))


def toxic_documents(docs: DataFrame, learned: Learned = NONE, *, id_col: str = "doc_id", text_col: str = "text", toxic_from: float = TOXIC_FROM) -> DataFrame:
    """id_col, toxicity (the sum of the clauses' scores, rounded to 4 digits), toxic_clauses (array of start, end in characters, and score), for documents
    of toxic_from at least, and three times what clean texts of as many words score more.

    Documents below, those with null or empty texts too, have no row; an empty table has none. Ids may be null or repeated: each row is scored by its text alone, so
    equal rows give equal rows. Whole texts are read, whatever their length. Of paths with equal weights any gives the same score. Other columns are not looked at, and none can clash with the result's own.
    """
    kind = dict(docs.dtypes)[id_col]
    d = docs.select(F.col(id_col), F.col(text_col).alias("t_"))
    m, known, only = grammar(), learned.units, trigger(learned.units)

    def run(batches):
        for batch in batches:
            # only clauses with one of these words can score
            hit = pc.fill_null(pc.match_substring_regex(batch.column(1), only), False)
            rows = np.flatnonzero(hit.to_numpy(zero_copy_only=False))
            got = []
            for r in rows:
                text = batch.column(1)[int(r)].as_py()
                c = clauses(text, m, known)
                s = round(sum(x[2] for x in c), 4)
                if s >= toxic_from and (not learned.rate or s >= toxic_from + 3 * learned.rate * len(_TOKEN.findall(text))):
                    got.append((int(r), s, [{"start": a, "end": b, "score": x} for a, b, x in c]))
            if got:
                shape = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([g[0] for g in got])), pa.array([g[1] for g in got]), pa.array([g[2] for g in got], shape)], names=[id_col, "toxicity", "toxic_clauses"])

    return d.mapInArrow(run, f"`{id_col}` {kind}, toxicity double, toxic_clauses array<struct<start:int,end:int,score:double>>")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxic_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
