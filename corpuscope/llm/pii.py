"""PII detection that undoes disguises and keeps offsets.

Transducers rewrite a text step by step: homoglyphs and invisible characters, spelled digits, disguised at and
dot signs. Every character that they write knows the span of source characters that it came from. Identifiers are detected in
the rewritten text and mapped back, so that the source text is redacted in place.
"""

from __future__ import annotations

import bisect
import ipaddress
import re
import unicodedata
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, table

#: Letters of other scripts that look like ASCII ones.
HOMOGLYPHS = dict(zip("аеорсухіјѕһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧАВЕКМНОРСТХονρ․．。＠﹫–‐‑−", "aeopcyxijshdqwABEZHIKMNOPTYXABEKMHOPCTXovp...@@----"))
_INVISIBLE = "​‌‍⁠﻿­"
_DIGITS = {w: str(d) for d, ws in enumerate(("zero oh null cero zéro", "one eins uno", "two zwei dos deux", "three drei tres trois", "four vier cuatro quatre", "five fünf cinco cinq", "six sechs seis", "seven sieben siete sept", "eight acht ocho huit", "nine neun nueve neuf")) for w in ws.split()}
_WORD = "|".join(sorted(_DIGITS, key=len, reverse=True))
#: Runs of so many spelled digits at least are digits; shorter ones are words, unless they touch digits.
SPELLED = 4
_SPELLED = re.compile(rf"(?i)(?<![^\W_])(?:{_WORD})(?:[\s,.\-]{{1,3}}(?:{_WORD}|\d))" + "{%d,}" % (SPELLED - 1) + r"(?![^\W_])")
_SPELLED_ONE = re.compile(rf"(?i)({_WORD})|([\s,.\-]+)")
_AT = re.compile(r"(?i)\s*[\[({<]\s*(?:at|@|arroba|ät)\s*[\])}>]\s*")
_DOT = re.compile(r"(?i)\s*[\[({<]\s*(?:dot|\.|punkt|punto|point)\s*[\])}>]\s*")
_SHORT = re.compile(rf"(?i)(?<![^\W_])(?:{_WORD})(?:[\s,.\-]{{1,3}}(?:{_WORD}))*(?![^\W_])")
_DIGIT_BEFORE, _DIGIT_AFTER = re.compile(r"\d[\s.\-]{1,3}$"), re.compile(r"[\s.\-]{1,3}\d")
#: All top-level domains in ASCII, and the reserved ones that examples use.
TLDS = frozenset(Path(__file__).with_name("tlds.txt").read_text().split())
#: Those that are words of prose too, and, after a real dot, endings of file names: they need context.
_PROSE = frozenset("able am an and are art as at bar be best bid by call can cash cat come day do dog eat fail fan fast fit fly free fun gives go got here home hot how id im in is it la le like live ma makes me mom moi my ne new next no now off on one open our pay pet place play read red rest rich rip run safe sale save se show si so su talk tab to today top tu va very vote watch weather win work works wow yes you your".split())
_FILES = frozenset("cc java md mov pl ps py rs sh so zip".split())
_SENT = re.compile(r"(?i)\b(?:e-?mails?|mail|writes?|contact|reach|message|reply|send|address|adresse|correo|courriel|schreib\w*|kontakt\w*|escrib\w*|contacte\w*|contacto|écri\w*)\b[^.!?\n]{0,40}$")
_CLOSE = re.compile(r"\s*(?:$|[.,;:!?)\]}>\"'])")
_ARTICLE = frozenset("the a an this that these those every each any some my your his her its our their one which what der die das den dem ein eine einem einer le la les l un une el los las una cada".split())
#: Words that stand before at in prose, and so aren't names.
_NO_NAME = _ARTICLE | frozenset("look looks looked looking see us me you him her it them i we they he she is are was were be been not now here there not only also or and visit visited found find available available online more details information info live page pages site website hosted sold bought buy shop read learn meet met met's arrive arrived work works worked working stay stays staying store stores stored posted published out in up down back again on off stop point aim error crash bug line file data code version images articles products blog posts videos books home start starts started stare stared smile laugh shout good bad best".split())
#: name at host dot domain: spoken signs and last labels in words are told from prose by the label and what is around it
_SAID = re.compile(r"(?i)(?<![\w.+-])([\w.+-]*?[a-z0-9+])(\s+at\s+|\s*@\s*|[_-]at[_-])([a-z0-9](?:[a-z0-9-]*?[a-z0-9])?(?:(?:\s+dot\s+|[_-]dot[_-]|\.)[a-z0-9](?:[a-z0-9-]*?[a-z0-9])?)*?(\s+dot\s+|[_-]dot[_-]|\.))([a-z]{2,24})(?![\w-])(?!\s+dot\s|\.[a-z0-9])")
_SAID_PART = re.compile(r"(?i)\s+dot\s+|[_-]dot[_-]")
_SAID_LEFT = re.compile(r"(?i)([\w-]+)\s+dot\s+(?=[\w.+-]+@)")

DETECTORS = [
    ("EMAIL", re.compile(r"(?<![\w.+%-])[\w](?:[\w.+%-]*[\w+%-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")),
    ("IBAN", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("CARD", re.compile(r"(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d])")),
    ("IP", re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)")),
    ("IP", re.compile(r"(?i)(?<![\w:])(?:[0-9a-f]{1,4}:){3,7}(?::?[0-9a-f]{1,4})(?![\w:])")),
    ("SSN", re.compile(r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])")),
    ("PHONE", re.compile(r"(?<![\w.+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d){6,12}(?!\d)")),
    ("PHONE", re.compile(r"(?<![\w.+-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])")),
    ("PHONE", re.compile(r"(?<![\w.+-])\d{10,11}(?!\w)")),
    ("SECRET", re.compile(r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|(?:sk|pk|rk)[-_][A-Za-z0-9_-]{20,}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|(?i:[0-9a-f]{32}(?:[0-9a-f]{8}|[0-9a-f]{32})?))(?![A-Za-z0-9])")),
    ("SECRET", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:.*?-----END [A-Z ]*PRIVATE KEY-----)?", re.S)),
]
#: What a text with an identifier, plain or disguised, must hold.
_PLAIN = r"[0-9@]|AKIA|[spr]k[-_]|gh[pousr]_|xox[abprs]-|PRIVATE KEY|\p{Nd}"
_ODD = "[" + "".join(re.escape(c) for c in HOMOGLYPHS) + _INVISIBLE + r"]|\p{M}|[\x{FF01}-\x{FF5E}]"
_DISGUISE = rf"(?i)[\[({{<]\s*(?:at|@|arroba|ät|dot|\.|punkt|punto|point)\s*[\])}}>]|[\s_-]dot[\s_-]|(?:\sat\s+|[_-]at[_-])[a-z0-9][a-z0-9.-]*\.[a-z]|[0-9][\s.\-]{{1,3}}(?:{_WORD})\b|\b(?:{_WORD})[\s,.\-]{{1,3}}(?:{_WORD}|[0-9])"


class Aligned:
    """A rewritten text whose characters know their spans in the source."""

    def __init__(self, text: str):
        self.text = text
        self.start: np.ndarray | None = None  # None: as the source
        self.end: np.ndarray | None = None

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Puts other strings in place of spans (ascending, apart). Each new character comes from its whole span; a span of the same length maps one to one."""
        if not edits:
            return
        n = len(self.text)
        s = np.arange(n) if self.start is None else self.start
        e = np.arange(1, n + 1) if self.end is None else self.end
        out, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            out += [self.text[at:a], new]
            starts.append(s[at:a])
            ends.append(e[at:a])
            if len(new) == b - a:
                starts.append(s[a:b])
                ends.append(e[a:b])
            else:
                starts.append(np.full(len(new), s[a]))
                ends.append(np.full(len(new), e[b - 1]))
            at = b
        out.append(self.text[at:])
        self.text, self.start, self.end = "".join(out), np.concatenate([*starts, s[at:]]), np.concatenate([*ends, e[at:]])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (int(self.start[a]), int(self.end[b - 1]))


_ODD_PY = re.compile("[" + "".join(re.escape(c) for c in HOMOGLYPHS) + _INVISIBLE + "！-～]|[^\x00-\x7f]")


def _plain(c: str) -> str:
    if c in _INVISIBLE:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if c.isdigit() and c.isdecimal():
        return str(unicodedata.digit(c))
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    return c


def _said(m: re.Match) -> bool:
    """Whether a match of _SAID is an address. A spoken dot with a last label that isn't a word of prose is; else the name and the host must not be
    words that prose has there, and a label that is such a word, or none that is known, needs a word of writing before, or the end of the clause after it."""
    name, at, host, dot, label = m.groups()
    if "@" in at and dot == ".":
        return bool(_SAID_PART.search(host))
    plain = label.lower() in TLDS and label.lower() not in _PROSE and not (dot == "." and label.lower() in _FILES)
    if plain and dot != "." and at[0] not in "_-":
        return True
    first = re.match(r"(?i)[a-z0-9-]+", host).group().lower()
    if name.lower() in _NO_NAME or first in _ARTICLE:
        return False
    sent = bool(_SENT.search(m.string, max(0, m.start() - 60), m.start()))
    if plain:
        return at[0] != "-" or dot != "." or sent
    if dot == "." and not (label.islower() or label.isupper()):
        return False  # two sentences without a space between
    return sent if label.lower() not in TLDS or at[0] == "-" else sent or bool(_CLOSE.match(m.string, m.end()))


def normalise(text: str, disguised: bool = True, odd: bool = True) -> Aligned:
    """The text without its disguises."""
    x = Aligned(text)
    if odd and not text.isascii():
        x.rewrite([(m.start(), m.end(), new) for m in _ODD_PY.finditer(text) if (new := _plain(m.group())) != m.group()])
    if disguised:
        x.rewrite([(m.start(), m.end(), _SPELLED_ONE.sub(lambda k: _DIGITS[k.group(1).lower()] if k.group(1) else "", m.group())) for m in _SPELLED.finditer(x.text)])
        x.rewrite([(m.start(), m.end(), _SPELLED_ONE.sub(lambda k: _DIGITS[k.group(1).lower()] if k.group(1) else "", m.group())) for m in _SHORT.finditer(x.text) if _DIGIT_AFTER.match(x.text, m.end()) or _DIGIT_BEFORE.search(x.text, max(0, m.start() - 4), m.start())])
        x.rewrite([(m.start(), m.end(), "@") for m in _AT.finditer(x.text)])
        x.rewrite([(m.start(), m.end(), ".") for m in _DOT.finditer(x.text)])
        edits = []
        for m in _SAID.finditer(x.text):
            if not _said(m):
                continue
            edits.append((*m.span(2), "@"))
            edits += [(m.start(3) + k.start(), m.start(3) + k.end(), ".") for k in _SAID_PART.finditer(m.group(3))]
        x.rewrite(edits)
        x.rewrite([(m.end(1), m.end(), ".") for m in _SAID_LEFT.finditer(x.text)])
    return x


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _valid(kind: str, s: str) -> bool:
    if kind == "CARD":
        digits = re.sub(r"\D", "", s)
        return len(set(digits)) > 1 and (luhn(digits) or len(digits) == 16)
    if kind == "IP":
        try:
            ipaddress.ip_address(s)
        except ValueError:
            return False
    if kind == "IBAN":
        s = s.replace(" ", "")
        return len(s) >= 15 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    if kind == "PHONE":
        return len(re.sub(r"\D", "", s)) >= 8
    if kind == "SECRET" and re.fullmatch("(?i)[0-9a-f]+", s):
        return bool(re.search("[0-9]", s)) and bool(re.search("(?i)[a-f]", s))
    return True


def find(text: str, disguised: bool = True, odd: bool = True) -> list[tuple[int, int, str, str]]:
    """Start and end in the source, kind, and normalised identifier; in order, apart. Of overlapping ones the first detector's stays; of one detector's the first."""
    x = normalise(text, disguised, odd)
    taken: list[tuple[int, int, str, str]] = []  # in order and apart, so only the neighbours of a place can overlap
    for kind, pattern in DETECTORS:
        for m in pattern.finditer(x.text):
            if _valid(kind, m.group()):
                a, b = x.source(*m.span())
                k = bisect.bisect_left(taken, (a,))
                if (k == len(taken) or taken[k][0] >= b) and (k == 0 or taken[k - 1][1] <= a):
                    taken.insert(k, (a, b, kind, m.group()))
    return taken


def redact_text(text: str, spans: list[tuple[int, int, str, str]]) -> str:
    out, at = [], 0
    for a, b, kind, _ in spans:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))


def redact(docs: DataFrame, *, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with identifiers in text_col replaced by [KIND], and pii_spans: array of start and end (characters of the source text), kind, and the identifier without disguise.

    A null text stays null, with a null pii_spans; an empty or clean one has an empty array. All rows stay, null or repeated ids too; equal texts get equal
    results. Whole texts are read, whatever their length; an empty table gives none. Extra columns pass through; a column called pii_spans makes the new one pii_spans_. length_col: a column that is
    set to the new length where the text was changed.
    """
    name = fresh(docs, "pii_spans")[0]
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])))])
    columns = docs.columns
    where = columns.index(text_col)
    size_at = columns.index(length_col) if length_col else None

    def run(batches):
        for batch in batches:
            text = batch.column(where)
            plain, odd, disguise = (pc.fill_null(pc.match_substring_regex(text, p), False).to_numpy(zero_copy_only=False) for p in (_PLAIN, _ODD, _DISGUISE))
            spans: list = [[] if v else None for v in text.is_valid().to_pylist()]
            rows = np.flatnonzero(plain | odd | disguise)
            changed: dict[int, str] = {}
            for r in rows.tolist():
                t = text[r].as_py()
                found = find(t, bool(disguise[r] or odd[r]), bool(odd[r]) or not t.isascii())
                if found:
                    spans[r] = [{"start": a, "end": b, "kind": k, "value": v} for a, b, k, v in found]
                    changed[r] = redact_text(t, found)
            out = list(batch.columns)
            if changed:
                at = np.zeros(len(text), bool)
                at[list(changed)] = True
                out[where] = pc.replace_with_mask(text, pa.array(at), pa.array([changed[r] for r in sorted(changed)], text.type))
                if size_at is not None:
                    out[size_at] = pc.replace_with_mask(out[size_at], pa.array(at), pa.array([len(changed[r]) for r in sorted(changed)], out[size_at].type))
            yield pa.RecordBatch.from_arrays([*out, pa.array(spans, _SPAN)], names=[*columns, name])

    return docs.mapInArrow(run, schema)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = redact(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "text", F.size("pii_spans").cast("int").alias("pii_count"), "pii_spans")
