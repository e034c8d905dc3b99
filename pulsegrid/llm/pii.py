"""PII by anchor expansion: one Aho-Corasick pass finds cues, local parsers expand and check what stands around them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Kinds in the order that decides between spans with the same start. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = 4
#: Cues that open an address or announce an identifier (found in lower, upper and title case).
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("iban", "account", "acct", "passport", "ssn", "password", "passwd", "token", "secret", "api_key", "apikey", "user id", "userid", "akia")

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
RUN = re.compile(r"[0-9]+")
QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"[^\s<>\"'`|\\^{}]+")
#: What may stand between a cue and its identifier, and the identifier: at least six characters, one of them a digit.
ASSIGN = re.compile(r"(?:(?:[_-][A-Za-z]{1,20}){1,4}(?=\s{0,3}[:=])|\s?(?:number|no\.?|key|id|(?i:number|no\.?|key|id)(?![A-Za-z0-9])))?\s{0,3}[:=#]?\s{0,3}[\"']?")
IDENTIFIER = re.compile(r"[A-Za-z0-9_-]+")
#: Numbers in groups, behind the cues that may have them: 6 to 34 digits in all.
GROUPS, GROUPED_CUES = re.compile(r"[0-9]{2,6}(?:[\x20-][0-9]{2,6})+(?![A-Za-z0-9])"), ("account", "acct", "passport", "ssn")
IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[\x20\xa0-]?[A-Za-z0-9]){11,30}")
# Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22,
    "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27,
    "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33,
    "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29,
    "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
AWS_TAIL = re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])")


@cache
def cue_automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for kind, cues in (("scheme", SCHEMES), ("cue", CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                found.add_word(form, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban_end(text: str, at: int) -> int:
    """End of the valid IBAN that starts at ``at``, grouped or not, or 0: as long as its country's, and 1 modulo 97."""
    m, length = IBAN.match(text, at), IBAN_LENGTHS.get(text[at : at + 2].upper(), 0)
    places = [i for i in range(at, m.end()) if text[i] not in " \xa0-"][:length] if m else []
    if not length or len(places) < length or text[places[-1] + 1 : places[-1] + 2].isalnum():
        return 0
    code = "".join(text[i] for i in places).upper()
    return places[-1] + 1 if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1 else 0


class IdentifierRuns:
    """Ends of identifiers: a run is read once, however many cues stand inside it."""

    def __init__(self, text: str):
        self.text, self.start, self.end, self.digit = text, 0, 0, -1

    def end_at(self, at: int) -> int:
        """End of the identifier at ``at`` (six characters or more, one of them a digit), or 0."""
        if not self.start <= at < self.end:
            m = IDENTIFIER.match(self.text, at)
            if not m:
                return 0
            self.start, self.end = at, m.end()
            self.digit = next((i for i in range(self.end - 1, at - 1, -1) if "0" <= self.text[i] <= "9"), -1)
        return self.end if self.end - at >= 6 and self.digit >= at else 0


def account_span(text: str, cue: str, at: int, runs: IdentifierRuns) -> tuple[int, int] | None:
    """(start, end) of the identifier at ``at``, behind ``cue``."""
    if cue == "iban":
        # "no" may be the country.
        return next(((start, end) for start in (at, at - 2) if (end := iban_end(text, start))), None)
    ends = [end] if (end := runs.end_at(at)) else []
    if cue in GROUPED_CUES:
        if cue in ("account", "acct") and (end := iban_end(text, at)):
            return at, end
        m = GROUPS.match(text, at)
        if m and 6 <= len(_only_digits(m[0])) <= 34:
            ends.append(m.end())
    return (at, max(ends)) if ends else None


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def find_pii(text: str) -> list[tuple[int, int, int]]:
    """(start, kind as its place in KINDS, end) of all spans, in order; each part of the text is expanded once per kind."""
    out: list[tuple[int, int, int]] = []
    email_end = card_end = quad_end = phone_end = url_end = account_end = 0
    runs = IdentifierRuns(text)
    for last, (kind, size) in cue_automaton().iter(text):
        at = last - size + 1
        if kind == "digit":
            if at >= quad_end:
                # A run of digits from its first one: an address is four runs; where fewer follow, none starts inside them either.
                m = QUAD.match(text, at)
                if m:
                    quad_end = m.end()
                    if all(int(part[-4:]) <= 255 and not part[:-4].strip("0") for part in m.groups()):
                        out.append((at, 1, m.end()))
                else:
                    quad_end = RUN.match(text, at).end()
            if at >= card_end:
                m = DIGITS.match(text, at)
                card_end = m.end() if m else at + 1
                if m:
                    digits = _only_digits(m[0])
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append((at, 2, m.end()))
        elif kind == "at":
            start = at
            while start > email_end and LOCAL.match(text, start - 1):
                start -= 1
            m = DOMAIN.match(text, at + 1) if start < at else None
            if m:
                email_end = m.end()
                out.append((start, 0, m.end()))
        elif kind == "plus":
            m = PHONE.match(text, at) if at >= phone_end else None
            if m:
                phone_end = m.end()
                if 9 <= len(_only_digits(m[0])) <= 15:
                    out.append((at, 3, m.end()))
        elif kind == "scheme":
            m = URL.match(text, last + 1) if at >= url_end else None
            if m:
                url_end = m.end() - (len(m[0]) - len(m[0].rstrip(".,;:!?)")))
                if url_end > last + 1:
                    out.append((at, 4, url_end))
        elif last >= account_end and (at == 0 or not text[at - 1].isalnum()):
            if text.startswith("AKIA", at):
                m = AWS_TAIL.match(text, last + 1)
                span = (at, m.end()) if m else None
            else:
                span = account_span(text, text[at : last + 1].lower(), ASSIGN.match(text, last + 1).end(), runs)
            if span:
                account_end = span[1]
                out.append((span[0], 5, span[1]))
    out.sort()
    return out


def pii_spans(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``spans``: array of (start, kind, end) in code points, end exclusive, by start and then kind.

    email, ip, card and phone are found as their expressions would, leftmost and non-overlapping by kind; url and account are added
    around schemes and identifier cues. One pass in Arrow batches without a shuffle; a null or empty text has no spans;
    a column of that name in the input is replaced.
    """
    name = prefix + "spans"
    docs = docs.drop(name)
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("end", T.LongType())]))
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                rows = batch.slice(first, 1024)
                spans = [[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in find_pii(x.as_py() or "")] for x in rows.column(text_col)]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(spans, arrow)], [*rows.schema.names, name])

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField(name, kind)]))
