"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits,
schemes and identifier cues. From each anchor a local parser grows the span to its
boundaries and validates it (label structure, octet range, Luhn, mod 97, digit
counts). Texts are handled one by one inside a task, whole, in time linear in their
length; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snarewatch.llm.common import alone

#: Order of kinds in every listing of spans; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "account", "address", "login", "secret")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(r"[0-9]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?: ?(?:number|no\.?|nr\.?|#))?\s?[:=#]?\s?([0-9](?:[ -]?[0-9]){5,16})(?![0-9])", re.I)
_LOGIN = re.compile(r"([^\s/@:]+:[^\s/@]+)@")
_VALUE = re.compile(r"\s?[:=]\s?[\"']?([A-Za-z0-9_+/.\-]{8,})")
_KEY_ID = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")
_TOKEN_ID = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![0-9A-Za-z])")
_KEY_HEAD = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
_KEY_END = re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
#: Names that a street may have before the word for its kind.
STREET_NAMES = 4

#: Cues of identifiers, each with the name of its parser; cased as written, capitalised and in capitals.
_CUES = {
    "account": ("account", "acct", "ssn", "social security"),
    "street": (" street", " avenue", " road", " lane", " boulevard", " drive"),
    "value": ("password", "passwd", "token", "api_key", "apikey", "secret"),
}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for sign, parser in (("@", "email"), ("+", "phone"), ("://", "login"), ("AKIA", "key"), ("ghp_", "key"), ("gho_", "key"), ("ghs_", "key"), ("-----BEGIN ", "block")):
        found.add_word(sign, (parser, len(sign)))
    for digit in _DIGIT:
        found.add_word(digit, ("digit", 1))
    for parser, cues in _CUES.items():
        for cue in cues:
            blank = " " if cue[0] == " " else ""
            for form in {cue, blank + cue.strip().capitalize(), cue.upper()}:
                found.add_word(form, (parser, len(form)))
    found.make_automaton()
    return found


_ANCHORS = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _iban(text: str) -> bool:
    code = text.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _from_runs(text: str, runs: list[tuple[int, int]], out: list) -> None:
    """Address literals, cards and account numbers, which are made of digit runs."""
    i, n = 0, len(runs)
    while i + 3 < n:
        four = runs[i : i + 4]
        if all(text[a[1]] == "." and a[1] + 1 == b[0] for a, b in zip(four, four[1:])):
            if all(b - a < 4 or not text[a:b].lstrip("0")[3:] for a, b in four) and all(int(text[a:b].lstrip("0") or "0") < 256 for a, b in four):
                out.append(("ip", four[0][0], four[3][1]))
            i += 4
        else:
            i += 1
    i = 0
    while i < n:
        j = i
        while j + 1 < n and runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] in " -":
            j += 1
        count = sum(b - a for a, b in runs[i : j + 1])
        if 16 <= count <= 19 and luhn("".join(text[a:b] for a, b in runs[i : j + 1])):
            out.append(("card", runs[i][0], runs[j][1]))
        i = j + 1
    done = 0
    for a, _ in runs:
        if a - 2 >= done and text[a - 2 : a].isupper() and (m := _IBAN.match(text, a - 2)) and (a == 2 or not text[a - 3].isalnum()) and _iban(m[0]):
            out.append(("account", m.start(), m.end()))
            done = m.end()


def _street_start(text: str, end: int) -> int:
    """Where an address begins whose names end at ``end``: house number, capitalised names; -1 if none does."""
    at = end
    for _ in range(STREET_NAMES):
        low = at
        while low and "a" <= text[low - 1] <= "z":
            low -= 1
        if low == at or low < 2 or not "A" <= text[low - 1] <= "Z" or text[low - 2] != " ":
            return -1
        at = low - 2
        first = at
        while first and at - first < 6 and text[first - 1] in _DIGIT:
            first -= 1
        if 0 < at - first < 6:
            return first
    return -1


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end) in code points, by kind, then start.

    Spans of one kind do not overlap; those of different kinds may. An empty text
    has none.
    """
    out: list[tuple[str, int, int]] = []
    runs: list[tuple[int, int]] = []
    at = dict.fromkeys(KINDS, 0)
    run_end = 0
    foot, no_foot = None, False  # the end of a key block found last; whether none is left

    def add(kind: str, start: int, end: int) -> None:
        if start >= at[kind]:
            out.append((kind, start, end))
            at[kind] = end

    for last, (parser, length) in _ANCHORS.iter(text):
        end = last + 1
        start = end - length
        if parser == "digit":
            if start >= run_end:
                run_end = _RUN.match(text, start).end()
                runs.append((start, run_end))
        elif parser == "email":
            left = start
            while left > at["email"] and text[left - 1] in _LOCAL:
                left -= 1
            if left < start and (m := _DOMAIN.match(text, end)):
                add("email", left, m.end())
        elif parser == "phone":
            if start >= at["phone"] and (m := _PHONE.match(text, start)):
                at["phone"] = m.end()
                if 8 <= sum(c in _DIGIT for c in m[0]) <= 15:
                    out.append(("phone", start, m.end()))
        elif parser == "login":
            if m := _LOGIN.match(text, end):
                add("login", m.start(1), m.end(1))
        elif parser == "key":
            if (m := _KEY_ID.match(text, start) or _TOKEN_ID.match(text, start)) and not (start and text[start - 1].isalnum()):
                add("secret", start, m.end())
        elif parser == "block":
            if start >= at["secret"] and not no_foot and (m := _KEY_HEAD.match(text, start)):
                if foot is None or foot.start() < m.end():
                    foot = _KEY_END.search(text, m.end())
                    no_foot = foot is None
                if foot is not None:
                    add("secret", start, foot.end())
        elif parser == "account":
            if m := _ACCOUNT.match(text, end):
                add("account", m.start(1), m.end(1))
        elif parser == "value":
            if (m := _VALUE.match(text, end)) and any(c in _DIGIT for c in m[1]):
                add("secret", m.start(1), m.end(1))
        elif end == len(text) or not text[end].isalnum():
            if (low := _street_start(text, start)) >= 0:
                add("address", low, end)
    _from_runs(text, runs, out)
    order = {kind: i for i, kind in enumerate(KINDS)}
    return sorted(out, key=lambda s: (order[s[0]], s[1]))


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or chain of overlapping spans, replaced by its first kind."""
    out, at, open_kind, stop = [], 0, None, 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if open_kind is not None and start < stop:
            stop = max(stop, end)
            continue
        if open_kind is not None:
            out.append(f"<{open_kind}>")
            at = stop
        out.append(text[at:start])
        open_kind, stop = kind, end
    if open_kind is not None:
        out.append(f"<{open_kind}>")
        at = stop
    out.append(text[at:])
    return "".join(out)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t.as_py() or "")] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans of every document: doc_id, spans array<struct<kind,start,end>>.

    Reads doc_id and text only. A null or empty text has no spans; repeated rows are
    rows of their own; no documents give no rows.
    """
    kept = docs.select("doc_id", "text")
    ddl = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>"
    return kept.mapInArrow(alone(_find), ddl)


def span_digests(found: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and listing of all spans, from ``personal_data``."""
    text = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    base_text = F.transform(base, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(F.array_join(base_text, ","), 256).alias("base_sha256"), F.array_join(text, ",").alias("spans"))


def mask_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of its text column replaced by their kinds.

    All other columns pass through as they are, whatever their names; a null text
    stays null.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else mask(t, find_spans(t)) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(alone(run), docs.schema)
