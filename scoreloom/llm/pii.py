"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, scheme separators, plus signs,
digits and identifier cues. From each anchor a deterministic local parser
expands to the boundaries of an email, network address, card, phone number,
login, IBAN (its country tells the length), account or secret and validates it. The four base kinds equal the
leftmost non-overlapping matches of their patterns, of which invalid ones are
dropped without a retry; further kinds never remove a base span.

Defined results: a null text is an empty one without spans; whole texts of any
length are scanned once; repeated rows have equal results; overlapping spans of
several kinds all count and are redacted as one; an empty table gives an empty
result; redaction leaves all other columns and clean texts as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.shared import rows_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "account", "secret")
#: Cues that a bank account number or a secret may follow.
ACCOUNT_CUES = ("account", "acct", "konto", "cuenta", "compte")
#: The length of an IBAN by its country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27,
    "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18,
    "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
SECRET_CUES = ("token", "password", "passwd", "secret", "api_key", "apikey", "access_key")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"://[^\s/@:]+(?::[^\s/@]*)?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]+)?")
#: Words that may stand between an account cue and its number, a few of them.
_ACCOUNT = re.compile(r"(?:\s*(?:#|\b(?:no\.?|nr\.?|number|nummer|n[uú]mero|num[eé]ro|is|ist|es|est|of|for|von|f[uü]r|de|du|the|my|our|your|mr\.?|ms\.?|mrs\.?|dr\.?|(?-i:[A-Z]\w*))(?!\w))){0,6}+\s*[:=#]?\s*([0-9](?:[ -]?[0-9]){5,16})(?![0-9])", re.IGNORECASE)
_KEY_ID = re.compile(r"[0-9A-Z]{16}(?![0-9A-Za-z])")
_SECRET = re.compile(r"\s*[=:]\s*(\"[^\"\s]{8,}\"|'[^'\s]{8,}'|[A-Za-z0-9_+/=-]{16,})")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for anchor, kind in [("@", "@"), ("+", "+"), ("://", ":"), *((d, "0") for d in "0123456789")]:
        found.add_word(anchor, (kind, len(anchor)))
    found.add_word("AKIA", ("key", 4))
    for cues, kind in ((ACCOUNT_CUES, "account"), (SECRET_CUES, "secret")):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


_ANCHORS = _automaton()


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def iban_end(text: str, at: int) -> int:
    """Where the IBAN that starts at ``at`` ends: its country gives the number of letters and digits; 0 if it is none."""
    left, code, end = IBAN_LENGTHS.get(text[at : at + 2], 0), [], at
    while left and end < len(text):
        c = text[end]
        if c.isascii() and (c.isdigit() or c.isupper()):
            code.append(c)
            left -= 1
        elif c != " " or text[end - 1] == " ":
            return 0
        end += 1
    if left or not code or text[end : end + 1].isalnum() or at and text[at - 1].isalnum():
        return 0
    return end if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1 else 0


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start, then kind as listed."""
    spans, ends = [], dict.fromkeys((*KINDS, "run"), 0)
    for last, (anchor, width) in _ANCHORS.iter(text):
        at = last - width + 1
        if anchor == "0":
            if at >= ends["ip"] and at >= ends["run"]:
                if m := _IP.match(text, at):
                    ends["ip"] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                        spans.append(("ip", at, m.end()))
                else:
                    # No later start in this run of digits can do better.
                    ends["run"] = _DIGITS.match(text, at).end()
            if at - 2 >= ends["iban"] and "A" <= text[at - 1] <= "Z" and (end := iban_end(text, at - 2)):
                ends["iban"] = end
                spans.append(("iban", at - 2, end))
            if at >= ends["card"] and (m := _CARD.match(text, at)):
                ends["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", at, m.end()))
        elif anchor == "@":
            start = at
            while start > ends["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                ends["email"] = m.end()
                spans.append(("email", start, m.end()))
        elif anchor == "+":
            if at >= ends["phone"] and (m := _PHONE.match(text, at)):
                ends["phone"] = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans.append(("phone", at, m.end()))
        elif anchor == ":":
            if at >= ends["login"] and (m := _LOGIN.match(text, at)):
                start = at
                while start > ends["login"] and text[start - 1].isascii() and text[start - 1].isalpha():
                    start -= 1
                if start < at:
                    ends["login"] = m.end()
                    spans.append(("login", start, m.end()))
        elif anchor == "key":
            if m := _KEY_ID.match(text, last + 1):
                spans.append(("secret", at, m.end()))
        elif at >= ends[anchor]:
            if m := {"account": _ACCOUNT, "secret": _SECRET}[anchor].match(text, last + 1):
                ends[anchor] = m.end(1)
                spans.append((anchor, m.start(1), m.end(1)))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(spans, key=lambda s: (s[1], order[s[0]], s[2]))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span becomes its kind in brackets; of overlapping spans, one mark for all."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_<base kind>..., base_sha256, spans)`` for every row."""
    counts = [f"n_{k}" for k in BASE]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in rows_of(batch, "text"):
                found = [find_spans(t) for t in texts]
                base = [[s for s in spans if s[0] in BASE] for spans in found]
                numbers = [pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in BASE]
                hashes = pa.array([hashlib.sha256(_joined(spans).encode()).hexdigest() for spans in base])
                yield pa.RecordBatch.from_arrays([part.column("id"), *numbers, hashes, pa.array(map(_joined, found), pa.string())], ["id", *counts, "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(digest, f"id long, {', '.join(f'{c} long' for c in counts)}, base_sha256 string, spans string")


def redact_documents(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``docs`` with every span of the text replaced, and the number of characters to match."""
    names = docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in rows_of(batch, text_col):
                found = [find_spans(t) for t in texts]
                changed = {i: redact(t, s) for i, (t, s) in enumerate(zip(texts, found, strict=True)) if s}
                columns = list(part.columns)
                if changed:
                    at = names.index(text_col)
                    columns[at] = pa.array([changed.get(i, t) for i, t in enumerate(part.column(at).to_pylist())], part.schema.field(at).type)
                    if chars_col in names:
                        at = names.index(chars_col)
                        columns[at] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(part.column(at).to_pylist())], part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(clean, docs.schema)
