"""Finding web addresses in running text.

A text is cut at white space and brackets, and a piece without a label behind a dot is passed over. In a
piece, words of name characters are cut at their dots into labels, which say where a host
begins and ends; scheme, user, port and path are then looked for around the host. Every
character is looked at a fixed number of times, so a piece of any length takes linear time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The most characters of a label and of a name's last label, and the digits of a port.
LABEL_MOST, LAST_MOST, PORT_DIGITS = 63, 24, (2, 5)
#: Closing marks at the end of an address belong to the sentence.
CLOSING = ".,);]!?'\""

_PIECE = re.compile(r"[^\s<>()]+")
#: What every host has: the start of a label behind a dot.
_DOTTED = re.compile(r"\.[a-z0-9]", re.ASCII | re.IGNORECASE)
_WORD = re.compile(r"[\w.%+-]+", re.ASCII)
_NAME = re.compile(r"[^\W_.-][a-z0-9.-]*", re.ASCII | re.IGNORECASE)
_DIGITS = "0123456789"


def _leading(text: str, fits: Callable[[str], bool], most: int) -> int:
    """How many characters at the start of ``text`` fit, ``most`` at most."""
    n = 0
    while n < min(len(text), most) and fits(text[n]):
        n += 1
    return n


def _letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


def _digit(c: str) -> bool:
    return c in _DIGITS


def hosts(run: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the hosts in a run of name characters, from the left.

    A host is a name, whose last label begins with two letters, or four numbers. A name
    takes as many labels as it can; a label that begins or ends with a hyphen or is empty
    ends it. Of a first label, what stands behind its leading hyphens counts.
    """
    labels = run.split(".")
    starts, at = [], 0
    for label in labels:
        starts.append(at)
        at += len(label) + 1
    last = [n if (n := _leading(label, _letter, LAST_MOST)) >= 2 else 0 for label in labels]
    whole = [0 < len(x) <= LABEL_MOST and x[0] != "-" and x[-1] != "-" for x in labels]
    # up to which label a name may go that goes on with label i
    upto = [-1] * (len(labels) + 1)
    for i in range(len(labels) - 1, -1, -1):
        upto[i] = upto[i + 1] if whole[i] and upto[i + 1] >= 0 else i if last[i] else -1
    i, low = 0, 0
    while i < len(labels) - 1:
        end = starts[i] + len(labels[i])
        first = run[max(starts[i], low, end - LABEL_MOST) : end].lstrip("-")
        if first and first[-1] != "-" and upto[i + 1] >= 0:
            i = upto[i + 1]
            low = starts[i] + last[i]
            yield end - len(first), low
            continue
        digits = _leading(first[::-1], _digit, 3)
        middle = labels[i + 1 : i + 3]
        if digits and i + 3 < len(labels) and all(0 < len(m) <= 3 and not m.strip(_DIGITS) for m in middle) and (more := _leading(labels[i + 3], _digit, 3)):
            i += 3
            low = starts[i] + more
            yield end - digits, low
            continue
        i += 1


def _rest(piece: str, at: int) -> int:
    """Where an address ends whose host ends at ``at``: behind a port, and a path up to the piece's end."""
    if piece[at : at + 1] == ":":
        n = _leading(piece[at + 1 : at + 1 + PORT_DIGITS[1]], _digit, PORT_DIGITS[1])
        if n >= PORT_DIGITS[0]:
            at += 1 + n
    return len(piece) if piece[at : at + 1] == "/" else at


def _addresses(piece: str) -> Iterator[tuple[int, int]]:
    done = 0  # no address begins before this

    def opened(at: int) -> int:
        before = piece[max(done, at - 8) : at].lower()
        return at - next((len(s) for s in ("https://", "http://") if before.endswith(s)), 0)

    word = _WORD.search(piece)
    while word:
        start, end = word.span()
        name = _NAME.match(piece, end + 1) if piece[end : end + 1] == "@" else None
        host = next(hosts(name[0]), None) if name and "." in name[0] else None
        if host and host[0] == 0:
            # the word is a user in front of a host
            found = opened(start), _rest(piece, end + 1 + host[1])
            yield found
            done = end = found[1]
        elif "." in word[0]:
            at = start
            for run in re.split("[_%+]", word[0]):
                for a, b in hosts(run):
                    found = opened(at + a), _rest(piece, at + b)
                    yield found
                    done = found[1]
                at += len(run) + 1
        word = _WORD.search(piece, max(done, end))


def spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of every address in a text, closing marks of its path included."""
    out = []
    for piece in _PIECE.finditer(text):
        if _DOTTED.search(piece[0]):
            out += [(piece.start() + a, piece.start() + b) for a, b in _addresses(piece[0])]
    return out


def addresses(text: str | None) -> list[str]:
    """Addresses of a text without their closing marks, the first of each spelling."""
    found: dict[str, str] = {}
    for a, b in spans(text or ""):
        url = text[a:b].rstrip(CLOSING)
        found.setdefault(url.lower(), url)
    return list(found.values())


def found_urls(text: Column) -> Column:
    """Array of the addresses in a text; a null text has none."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([addresses(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(text)


def replaced(text: Column, before: str, after: str, shown: bool = True) -> Column:
    """The text with each address between ``before`` and ``after``, or with both in its place; null stays null."""

    def mark(t: str) -> str:
        out, at = [], 0
        for a, b in spans(t):
            out += [t[at:a], before, t[a:b] if shown else "", after]
            at = b
        return "".join([*out, t[at:]])

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None else mark(t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(text)
