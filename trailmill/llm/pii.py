"""Personal data: anchors found by an Aho-Corasick automaton, expanded by local parsers.

The automaton meets every at-sign, scheme separator, digit, street word and
identifier cue in one pass over the text. Each anchor names a kind; the parser of
that kind takes the maximal run of that kind's alphabet around the anchor (a plus
sign before a digit belongs to the phone run) and parses just this run. A match
of a kind never leaves such a run, so leftmost, non-overlapping matches of the
runs are those of the whole text. A run is read once from left to right, so the
time grows with the length of the text, long runs of digits included.

Base kinds (their matches always stay): email, ip, card, phone. The method adds
url (scheme and host), iban (mod-97 check), account (digits or grouped digits
after a cue such as "account") and address (number and street word).

Edge cases: a null text counts as empty and gives zero counts, an empty spans
string and the hash of the empty string; a null doc_id stays null; repeated rows
are scanned each by itself; columns with clashing names are ignored, for the
input is cut to doc_id and text before any output column is added. Rows never
leave their partition, so there is no shuffle, and no key can be hot.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, documents, lean, slices

BASE = ("email", "ip", "card", "phone")
#: Order of the kinds in a spans string.
KINDS = (*BASE, "url", "iban", "account", "address")

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"(?:https?|ftp)://[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?(?:/[^\s<>\"']*)?")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"[\x20:#.]{0,3}(?:no\.?|number|nr\.?)?[\x20:#.]{0,3}([0-9](?:[\x20-]?[0-9]){5,17})", re.I)
ADDRESS = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5}\x20(?:[A-Z][a-z]+\x20){1,3}(?:Street|Avenue|Road|Lane|Boulevard)(?![A-Za-z])")

#: Cues that begin an account or address span. Fixed values.
ACCOUNT_CUES = ("account", "konto", "compte", "cuenta", "passport", "ssn")
STREET_CUES = (" Street", " Avenue", " Road", " Lane", " Boulevard")
IBAN_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Runs of the alphabets of ip, card and phone: a match holds no other character.
_DIGIT_DOT = re.compile(r"[0-9.]+")
_DIGITS = re.compile(r"[0-9]+")
_DIGIT_RUN = re.compile(r"[0-9](?:[0-9\x20-]*[0-9])?")
_PHONE_RUN = re.compile(r"[+0-9\x20().-]+")


def automaton() -> ahocorasick.Automaton:
    """Anchors and the kinds they may begin."""
    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    a.add_word("://", ("url", 3))
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    for cue in ACCOUNT_CUES:
        for form in (cue, cue.capitalize(), cue.upper()):
            a.add_word(form, ("account", len(cue)))
    for cue in STREET_CUES:
        a.add_word(cue, ("address", len(cue)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    """ISO 13616: rotate four characters, letters as 10 to 35, remainder 1 modulo 97."""
    compact = text.replace(" ", "")
    if not 15 <= len(compact) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _small(part: str) -> bool:
    """Whether a run of digits, however long, is at most 255."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str, ats: list[int], out: list) -> None:
    """Expand each at-sign left over local and right over domain characters."""
    floor = 0
    for at in ats:
        if at < floor:
            continue
        start = at
        while start > floor and (text[start - 1].isalnum() and text[start - 1].isascii() or text[start - 1] in "._%+-"):
            start -= 1
        if start == at:
            continue
        m = EMAIL.match(text, start)
        if m:
            out.append(("email", start, m.end()))
            floor = m.end()


def _ips(text: str, start: int, end: int, out: list) -> None:
    """Groups of digits one dot apart, four by four from the left of a run; a four with a part over 255 is spent all the same."""
    four: list[tuple[int, int]] = []
    for m in _DIGITS.finditer(text, start, end):
        if four and m.start() != four[-1][1] + 1:
            four = []
        four.append(m.span())
        if len(four) == 4:
            if all(_small(text[a:b]) for a, b in four):
                out.append(("ip", four[0][0], four[3][1]))
            four = []


def _digit_kinds(text: str, digits: list[int], out: list) -> None:
    """Around each run of digits, parse the runs of the ip, card and phone alphabets."""
    ip_to = card_to = phone_to = -1
    for p in digits:
        if p >= ip_to:
            m = _DIGIT_DOT.match(text, p)
            ip_to = m.end()
            if m.end() - p >= 7:
                _ips(text, p, ip_to, out)
        if p >= card_to:
            m = _DIGIT_RUN.match(text, p)
            card_to = m.end()
            if card_to - p >= 13:
                for x in CARD.finditer(text, p, card_to):
                    number = x[0].replace(" ", "").replace("-", "")
                    if 13 <= len(number) <= 19 and luhn(number):
                        out.append(("card", x.start(), x.end()))
        if p >= phone_to:
            start = p - 1 if p and text[p - 1] == "+" else p
            m = _PHONE_RUN.match(text, start)
            phone_to = m.end()
            if "+" in m[0]:
                for x in PHONE.finditer(text, start, phone_to):
                    if 9 <= sum(c.isdigit() for c in x[0]) <= 15:
                        out.append(("phone", x.start(), x.end()))


def find_spans(text: str | None, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) by kind as in KINDS, then start; ends are exclusive, in code points."""
    if not text:
        return []
    ats: list[int] = []
    digits: list[int] = []
    out: list[tuple[str, int, int]] = []
    for end, (kind, width) in anchors.iter(text):
        if kind == "digit":
            digits.append(end)
        elif kind == "email":
            ats.append(end)
        elif kind == "url":
            head = end - width + 1
            for scheme in ("https", "http", "ftp"):
                if text.endswith(scheme, 0, head) and (m := URL.match(text, head - len(scheme))):
                    out.append(("url", m.start(), m.end()))
                    break
        elif kind == "account":
            if m := ACCOUNT.match(text, end + 1):
                out.append(("account", m.start(1), m.end(1)))
        else:
            low = max(0, end - 80)
            if (found := [m for m in ADDRESS.finditer(text, low, min(len(text), end + 2)) if m.end() == end + 1]):
                out.append(("address", found[0].start(), found[0].end()))
    if ats:
        _emails(text, ats, out)
    if digits:
        _digit_kinds(text, digits, out)
        done = -1
        for p in digits:  # an IBAN has two letters before its first digit
            if p >= 2 and p > done and text[p - 1] in IBAN_LETTERS and text[p - 2] in IBAN_LETTERS and (m := IBAN.match(text, p - 2)):
                done = m.end()
                if iban_ok(m[0]):
                    out.append(("iban", m.start(), m.end()))
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(out), key=lambda s: (rank[s[0]], s[1], s[2]))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, spans (array of kind, start, end) and the redacted text."""
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, spans array<struct<kind:string,start:int,end:int>>, redacted string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for whole in batches:
            for b in slices(whole, text_col):
                texts = b.column(text_col).to_pylist()
                spans = [find_spans(t, anchors) for t in texts]
                clean = [t if not s else redact(t, s) for t, s in zip(texts, spans)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(id_col), pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans], kind), pa.array(clean, pa.string())],
                    [id_col, "spans", "redacted"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of its text replaced by the span's kind; n_chars, where there is such a column, follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for whole in batches:
            for b in slices(whole):
                clean = [redact(t, find_spans(t, anchors)) if t else t for t in b.column("text").to_pylist()]
                columns = dict(zip(b.schema.names, b.columns))
                columns["text"] = pa.array(clean, pa.string())
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([None if t is None else len(t) for t in clean], columns["n_chars"].type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(lean(run), docs.schema)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the op10 query, with the spans themselves cut to strings in the worker."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for whole in batches:
            for b in slices(whole):
                rows = []
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    spans = find_spans(text, anchors)
                    base = [s for s in spans if s[0] in BASE]
                    n = [sum(s[0] == k for s in base) for k in BASE]
                    rows.append((doc, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
                frame = pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))


QUERIES = {"op10_pii": op10_pii}
ORACLE: dict[str, str] = {}
