"""Personal data: anchors found by an Aho-Corasick automaton, spans grown and checked by local parsers.

One pass of the automaton over a text finds at-signs, digits, plus signs, schemes and identifier cues. Around
each anchor a deterministic parser expands to the boundaries of its kind and validates what it took:

- base kinds, leftmost and without overlap within a kind: `email`, `ip` (parts at most 255), `card` (16 to 19
  digits, Luhn), `phone` (8 to 15 digits); a match that fails its check is dropped and not tried again;
- further kinds: `url` (scheme); `account` (after a cue: an IBAN, also in groups, whose remainder by 97 is 1, an identifier of the
  shape that the cue asks for (`SHAPES`), or after ":" or "=" any value of eight characters with a digit); `address` (house
  number and street in English, German, French and Spanish order).

Spans are code points, end exclusive. Spans of different kinds may overlap; `redact` replaces their union, so no character of any
span is left. A null text counts as empty (and stays null in `redact`); texts are read whole, of any length, in time
linear in it; repeated rows give the same spans; `detect` reads only the text and id, `redact` hands the other columns on,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "address")

# Character sets of the base kinds and the cues of the further ones.
DIGITS = "0123456789"
ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + DIGITS
LOCAL = ALNUM + "._%+-"
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "iban", "account", "acct", "passport", "ssn")
STREETS = ("street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "drive", "boulevard", "blvd", "straße", "strasse", "platz")
STREET_ENDS = ("straße", "strasse", "gasse", "allee", "platz")
STREET_STARTS = ("Calle", "Avenida", "Paseo", "Plaza")
# Identifiers that a cue asks for, with or without a sign between.
SHAPES = {
    "ssn": r"[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}",
    "passport": r"[A-Z]{0,2}[0-9]{6,9}",
    "account": r"[0-9](?:[ -]?[0-9]){6,19}",
    "acct": r"[0-9](?:[ -]?[0-9]){6,19}",
}

_email_rest = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_url_rest = re.compile(r"[^\s<>\"'`]+")
_value = re.compile(r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9][A-Za-z0-9_+/.=-]{7,})")
_street = re.compile(r"[0-9]{1,5}[A-Za-z]? ((?:[^\W\d_]++\.? ?){2,5})")


_word = re.compile(r"[^\W\d_]+")
_iban = re.compile(r"[\s:=.#-]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_shapes = {cue: re.compile(rf"(?i:[ .]{{0,2}}(?:no|nr|number|num)?)[\s.:=#]{{1,4}}({shape})(?![A-Za-z0-9])") for cue, shape in SHAPES.items()}
_after_street = re.compile(r" [0-9]{1,5}[A-Za-z]?(?![\w])")
_spanish = re.compile(r" (?:(?:de|del|la|las|los|el) ){0,3}(?:[A-ZÁÉÍÓÚÑ][^\W\d_]*+,? ){1,4}(?:n\.?º ?)?[0-9]{1,5}(?![\w])")
_french = re.compile(r"[0-9]{1,5}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|impasse|quai|allée) (?:(?:de|du|des|la|le|les) |d'|l'){0,3}[A-ZÀ-Ý][^\W\d_]*+(?:[ -][A-ZÀ-Ý][^\W\d_]*+){0,3}")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w, kind in [("@", "email"), ("+", "phone"), *[(d, "digit") for d in DIGITS], *[(s, "url") for s in SCHEMES]]:
        a.add_word(w, (kind, len(w)))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            a.add_word(form, ("account " + cue, len(form)))
    for kind, words in (("street end", STREET_ENDS), ("street start", STREET_STARTS)):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


_anchors = _automaton()


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def iban(value: str) -> int:
    """How much of a value is an IBAN: its length, or 0. A last group that spoils the check is another word."""
    for part in (value, value.rpartition(" ")[0]):
        plain = part.replace(" ", "")
        if 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
            return len(part)
    return 0


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """All spans of a text by kind, each kind's in order."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    # Where the next match of a kind may begin; the last at-sign seen bounds an email's start.
    email_from = last_at = ip_from = card_from = phone_from = url_from = value_from = street_from = 0
    for end, (kind, size) in _anchors.iter(text):
        at = end - size + 1
        if kind == "digit":
            before = text[at - 1] if at else " "
            if at >= ip_from and (m := _ip.match(text, at)):
                ip_from = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                    out["ip"].append(m.span())
            elif at >= ip_from and before not in DIGITS:
                ip_from = _run_end(text, at)  # no match can begin inside this run either
            if at >= card_from:
                if m := _card.match(text, at):
                    card_from = m.end()
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append(m.span())
            if at >= street_from and before not in ALNUM and (m := _street.match(text, at)):
                words = list(_word.finditer(text, m.start(1), m.end()))
                n = next((k for k, w in enumerate(words) if k and w.group().lower() in STREETS), None)
                if n and all(w.group()[0].isupper() for w in words[:n]):
                    street_from = words[n].end()
                    out["address"].append((at, street_from))
            if at >= street_from and before not in ALNUM and (m := _french.match(text, at)):
                street_from = m.end()
                out["address"].append(m.span())
        elif kind == "email":
            lo = max(email_from, last_at)
            head = text[lo:at]
            a = lo + len(head.rstrip(LOCAL))
            last_at = at + 1
            if a < at and (m := _email_rest.match(text, at)):
                out["email"].append((a, m.end()))
                email_from = m.end()
        elif kind == "phone":
            if at >= phone_from and (m := _phone.match(text, at)):
                phone_from = m.end()
                if 8 <= sum(c in DIGITS for c in m.group()) <= 15:
                    out["phone"].append(m.span())
        elif kind == "url":
            if at >= url_from and (m := _url_rest.match(text, end + 1)):
                z = end + 1 + len(m.group().rstrip(".,;:!?)]}"))
                if z > end + 1:
                    out["url"].append((at, z))
                    url_from = z
        elif kind == "street end":
            a = at
            while a > street_from and at - a < 40 and (text[a - 1].isalpha() or text[a - 1] == "-"):
                a -= 1
            if a < at and text[a].isupper() and (m := _after_street.match(text, end + 1)):
                street_from = m.end()
                out["address"].append((a, street_from))
        elif kind == "street start":
            if at >= street_from and (m := _spanish.match(text, end + 1)):
                street_from = m.end()
                out["address"].append((at, street_from))
        elif at < value_from:
            continue
        elif kind == "account iban" and (m := _iban.match(text, end + 1)) and (size := iban(m.group(1))):
            value_from = m.start(1) + size
            out["account"].append((m.start(1), value_from))
        elif kind[8:] in _shapes and (m := _shapes[kind[8:]].match(text, end + 1)):
            value_from = m.end()
            out["account"].append(m.span(1))
        elif m := _value.match(text, end + 1):
            value = m.group(1).rstrip(".=") if not m.group(1).endswith("==") else m.group(1)
            if any(c in DIGITS for c in value):
                out["account"].append((m.start(1), m.start(1) + len(value)))
            value_from = m.end()
    return out


def _run_end(text: str, at: int) -> int:
    while at < len(text) and text[at] in DIGITS:
        at += 1
    return at


def merged(spans: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    """The union of the spans of all kinds in text order; what overlaps is one, of the kind that begins first (then the longer)."""
    out: list[tuple[str, int, int]] = []
    for a, _, _, z, k in sorted((a, a - z, KINDS.index(k), z, k) for k, s in spans.items() for a, z in s):
        if not out or a >= out[-1][2]:
            out.append((k, a, z))
        else:
            out[-1] = (*out[-1][:2], max(out[-1][2], z))
    return out


def redact_text(text: str) -> str:
    """The text with every span replaced by its kind in brackets."""
    done, parts = 0, []
    for k, a, z in merged(find_spans(text)):
        parts += [text[done:a], f"[{k.upper()}]"]
        done = z
    return "".join([*parts, text[done:]])


def detect(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """row_id and spans (an array of kind, start, end: by kind, then start) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            got = [[{"kind": k, "start": a, "end": z} for k, s in find_spans(t or "").items() for a, z in s] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, kind)], [row_id, "spans"])

    return docs.select(F.col(row_id).cast("long").alias(row_id), F.col(text).cast("string")).mapInArrow(run, f"{row_id} long, spans array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame, row_id: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, a hash of the base spans and all spans as text, of each row of `detect`."""
    line = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select(row_id, *count, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the spans of its text replaced by [KIND]; null texts stay null."""
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([None if t is None else redact_text(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(b.columns)], names)

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))
