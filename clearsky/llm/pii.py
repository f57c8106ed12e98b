"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over the whole text:
at-signs, plus-signs, digits, schemes (``https://``) and identifier cues
(``iban``, ``account no``). Local parsers expand each anchor to its boundaries
and validate it:

* ``email``: the local part left of an at-sign, the dotted domain right of it;
* ``ip``: four dotted numbers of at most 255;
* ``card``: 13 to 19 digits with single separators that pass the Luhn sum;
* ``phone``: a plus-sign and 9 to 15 digits;
* ``login``: an address with credentials, ``scheme://user:secret@host``;
* ``account``: an identifier behind a cue - an IBAN with the right check number,
  or 6 to 24 letters and digits, half of them digits at least - or a hexadecimal secret
  of 32 places or more behind ``token``, ``secret`` or ``api_key``.

The first four follow fixed patterns, leftmost and not overlapping within a kind;
a match that fails its validation is used up and not tried again.

Cases: null and empty texts give no spans; positions are code points, end exclusive;
an identifier's digits are scanned once, so very long texts and runs take linear time;
repeated rows are scanned each; further columns are ignored by :func:`scan`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "account")

# Anchors and cues.
SCHEMES = ["http://", "https://", "ftp://", "ftps://", "ssh://", "sftp://"]
ACCOUNT_CUES = ["iban", "account", "acct", "konto", "kontonummer", "compte", "cuenta", "passport", "ssn", "routing"]
SECRET_CUES = ["token", "secret", "api_key", "apikey", "api key", "password"]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_CHAIN = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
_PHONE_BODY = re.compile(r"[0-9][ ().0-9-]+")
_CREDENTIALS = re.compile(r"[^\s:/?#@]+:[^\s/?#@]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
_CUE_GAP = re.compile(r"(?:\s?(?:number|nummer|no|nr|n°|id))?\.?\s{0,2}[:=#]?\s{0,2}[\"']?", re.IGNORECASE)
_IDENTIFIER = re.compile(r"[A-Za-z0-9]+(?:[ -][A-Za-z0-9]+)*")
_SECRET = re.compile(r"[0-9A-Fa-f]{32,}")
_automata: list = []


def _automaton():
    if not _automata:
        import ahocorasick

        found = ahocorasick.Automaton()
        for mark in "@+0123456789":
            found.add_word(mark, (mark if mark in "@+" else "0", 1))
        for kind, words in (("scheme", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
            for word in words:
                found.add_word(word, (kind, len(word)))
        found.make_automaton()
        _automata.append(found)
    return _automata[0]


def _folded(text: str) -> str:
    """Lower case of the same length, so that places agree."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _iban(code: str) -> bool:
    if not (15 <= len(code) <= 34 and code[:2].isalpha() and code[2:4].isdigit() and code.isascii()):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    if start == at:
        return None
    domain = _DOMAIN.match(text, at + 1)
    return (start, domain.end()) if domain else None


def _ip(text: str, start: int) -> tuple[int, bool] | None:
    """End and validity of four dotted numbers, if they stand here."""
    valid, at = True, start
    for part in range(4):
        if part:
            if text[at : at + 1] != ".":
                return None
            at += 1
        run = _DIGITS.match(text, at)
        if not run:
            return None
        digits = run.group().lstrip("0")
        valid = valid and len(digits) <= 3 and int(digits or 0) <= 255
        at = run.end()
    return at, valid


def _phone(text: str, plus: int) -> tuple[int, int] | None:
    body = _PHONE_BODY.match(text, plus + 1)
    if not body:
        return None
    whole = body.group().rstrip(" ().-")
    if len(whole) < 3:
        return None
    digits = sum(c.isdigit() for c in whole)
    return (plus, plus + 1 + len(whole)) if 9 <= digits <= 15 else None


def _account(text: str, end: int, secret: bool) -> tuple[int, int] | None:
    start = _CUE_GAP.match(text, end).end()
    if start == end:
        return None
    if secret:
        found = _SECRET.match(text, start)
        return found.span() if found else None
    found = _IDENTIFIER.match(text, start)
    if not found:
        return None
    # An IBAN may have blanks; anything else ends at the first one.
    code, stop, places = "", start, []
    for part in re.finditer(r"[A-Za-z0-9]+", text[start : min(found.end(), start + 60)]):
        code += part.group().upper()
        stop = start + part.end()
        places.append((code, stop))
    for code, stop in reversed(places):
        if _iban(code):
            return start, stop
    code, stop = places[0]
    digits = sum(c.isdigit() for c in code)
    return (start, stop) if 6 <= len(code) <= 24 and 2 * digits >= len(code) else None


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end), by kind as listed in KINDS, then start."""
    if not text:
        return []
    out: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    after_email = after_ip = after_card = after_login = after_account = 0
    for last, (anchor, width) in _automaton().iter(_folded(text)):
        at = last - width + 1
        if anchor == "@":
            if at >= after_email and (span := _email(text, at, after_email)):
                out["email"].append(span)
                after_email = span[1]
        elif anchor == "0":
            if at >= after_ip:
                if four := _ip(text, at):
                    after_ip, valid = four
                    if valid:
                        out["ip"].append((at, after_ip))
                else:  # the tail of this run of digits would match no better
                    after_ip = _DIGITS.match(text, at).end()
            if at >= after_card:
                chain = _CHAIN.match(text, at)
                digits = re.sub("[ -]", "", chain.group())
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(chain.span())
                after_card = chain.end()
        elif anchor == "+":
            if span := _phone(text, at):
                out["phone"].append(span)
        elif anchor == "scheme":
            found = _CREDENTIALS.match(text, last + 1)
            if found and at >= after_login:
                out["login"].append((at, found.end()))
                after_login = found.end()
        elif at >= after_account and not (at and text[at - 1].isalnum()):
            if span := _account(text, last + 1, anchor == "secret"):
                out["account"].append(span)
                after_account = span[1]
    return [(kind, start, end) for kind in KINDS for start, end in out[kind]]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the numbers of base spans, the digest of the base spans and all spans."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string"

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["t"]:
                spans = find(text)
                base = [s for s in spans if s[0] in BASE_KINDS]
                counts = [sum(s[0] == k for s in base) for k in BASE_KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            out = pd.DataFrame(rows, columns=[f"n_{k}" for k in BASE_KINDS] + ["base_sha256", "spans"])
            out.insert(0, "doc_id", batch["i"].array)
            yield out

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInPandas(scanned, schema)
