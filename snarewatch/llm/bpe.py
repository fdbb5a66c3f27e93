"""Byte-level BPE with a minimal acyclic transducer as lexicon.

Words that are frequent in the corpus are compiled with their ids into an automaton
that shares prefixes and suffixes; the numbers on its arcs sum to the word's place
in a table of id runs. The file is sent to every executor, which maps it into
memory. Words outside it are merged exactly, pair by pair. Both give what the
vocabulary's merges say, so the lexicon changes the speed and never the ids.

Texts are taken in groups: a group's words are told apart once, and those not met
lately walk the automaton and are merged side by side, in arrays.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import mmap
import os
import struct
import tempfile
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snarewatch.llm.common import hold

#: A word is frequent from so many occurrences a character on; there are at most 1 / share.
MIN_SHARE = 2e-7
#: Entries of each of a worker's four tables of words and chunks it has met, some 90 MB in all
#: after 39 million characters; a full one starts anew. Rare words are most of those that are merged.
MEMO = 300_000
#: The split of byte-level BPE into words, a fixed value of the vocabulary's family.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPLIT = regex.compile(SPLIT)
#: Found in texts that are empty or have a gap other than one blank or one line feed between two words.
ODD = r"\A\z|\A[ \n]|[ \n]\z|[ \n][ \n]|[\t\x0B\f\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Bytes of texts that are encoded at once; a text is never cut, however long.
GROUP = 1 << 21


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files, and back."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _joined(table: pa.Array, ids: pa.ListArray, comma: bytes) -> list[bytes]:
    """The entries of a table at each text's ids in one string."""
    entries = pa.ListArray.from_arrays(ids.offsets, table.take(ids.values))
    return pc.binary_join(entries, pa.scalar(comma, pa.large_binary())).to_pylist()


class Vocabulary:
    """Merges and ids of a tokenizer file's text."""

    def __init__(self, file_text: str) -> None:
        spec = json.loads(file_text)
        letters = _byte_letters()
        spell = lambda token: bytes(letters[c] for c in token)
        ids = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in ids.items():
            if token not in self.special:
                self.bytes_of[i] = spell(token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.unit = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []  # by rank
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[ids[a], ids[b]] = rank
            self.merged.append(ids[a + b])
        self.ranks, self.size = np.array([*self.merged, 0], np.int32), len(self.bytes_of)
        pairs = np.array([a * self.size + b for a, b in self.rank], np.int64)
        order = pairs.argsort()
        self.pairs = np.append(pairs[order], np.iinfo(np.int64).max)  # sorted, for many at once
        self.rank_of = np.append(np.array([*self.rank.values()], np.int32)[order], len(self.merged)).astype(np.int32)
        self.units = np.array(self.unit, np.int32)
        self.unit_ranks = self._ranks(np.repeat(self.units, 256), np.tile(self.units, 256))
        self.decimals = pa.array([b"%d" % i for i in range(self.size)], pa.large_binary())
        self.spelled = pa.array(self.bytes_of, pa.large_binary())
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word: the pair of lowest rank, leftmost first, is merged until none is left."""
        ids = [self.unit[b] for b in word]
        if len(ids) > 48:
            return self._merge_long(ids)
        rank, none = self.rank.get, len(self.merged)
        ranks = [rank(pair, none) for pair in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            ids[i : i + 2] = [self.merged[low]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), none)
        return tuple(ids)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or the number of merges where there is none."""
        wanted = a.astype(np.int64) * self.size + b
        at = self.pairs.searchsorted(wanted)
        return np.where(self.pairs[at] == wanted, self.rank_of[at], np.int32(len(self.merged)))

    def merge_many(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """``merge`` of each word. Words of one length are merged side by side, one pair a round."""
        out: list[tuple[int, ...]] = [()] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        for n, at in by_length.items():
            if len(at) < 4 or not 0 < n <= 48:
                for i in at:
                    out[i] = self.merge(words[i])
                continue
            raw = np.frombuffer(b"".join([words[i] for i in at]), np.uint8).reshape(-1, n)
            ids, rows, ranks = self.units[raw], np.array(at), np.full(raw.shape, len(self.merged), np.int32)
            ranks[:, :-1] = self.unit_ranks[raw[:, :-1].astype(np.int32) * 256 + raw[:, 1:]]  # of each id with the next
            for width in range(n, 0, -1):  # as many ids in each row that is not done
                place = ranks.argmin(1)  # the leftmost of the lowest
                low = ranks[np.arange(len(rows)), place]
                done = low == len(self.merged)
                for i, run in zip(rows[done].tolist(), ids[done].tolist(), strict=True):
                    out[i] = tuple(run)
                if done.any():
                    ids, ranks, rows, place, low = (x[~done] for x in (ids, ranks, rows, place, low))
                if not len(rows):
                    break
                ids[np.arange(len(rows)), place] = self.ranks[low]
                ids = ids[np.arange(width) != place[:, None] + 1].reshape(-1, width - 1)
                ranks = ranks[np.arange(width) != place[:, None]].reshape(-1, width - 1)
                left, right = np.flatnonzero(place > 0), np.flatnonzero(place < width - 2)
                row, col = np.concatenate([left, right]), np.concatenate([place[left] - 1, place[right]])
                ranks[row, col] = self._ranks(ids[row, col], ids[row, col + 1])
        return out

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same with a heap and links, for words of any length."""
        n, rank = len(ids), self.rank.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            low, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.merged[low], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := rank((ids[left], ids[right]))) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return tuple(i for i in ids if i >= 0)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def decode_many(self, ids: pa.ListArray) -> list[str]:
        """``decode`` of each text's ids."""
        return [x.decode("utf-8", "replace") for x in _joined(self.spelled, ids, b"")]

    def decimals_many(self, ids: pa.ListArray) -> list[bytes]:
        """Decimal ids of each text, joined by commas."""
        return _joined(self.decimals, ids, b",")


def compile_lexicon(entries: dict[bytes, tuple[int, ...]]) -> bytes:
    """A minimal acyclic transducer over the entries, as the bytes of a file.

    Built from sorted words: once a word leaves a branch, the branch's states are
    replaced by equal ones met before. Layout, little-endian: counts, then per state
    its first arc and whether it ends a word, per arc label, target and how many
    words come before it in its state, per word where its ids begin, and the ids;
    last, per arc 256 times its state plus its label, which ascends.
    """
    words = sorted(entries)
    known: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int]]]] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in known:
            known[key] = len(states)
            states.append((node[0], list(node[1])))
        return known[key]

    path: list[list] = [[False, []]]  # open states of the current word
    labels: list[int] = []

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            node = path.pop()
            path[-1][1].append((labels.pop(), settle(node)))

    for word in words:
        common = len(os.path.commonprefix([bytes(labels), word]))
        close(common)
        for b in word[common:]:
            labels.append(b)
            path.append([False, []])
        path[-1][0] = True
    close(0)
    root = settle(path[0])

    below = array("I")  # words in reach of each state; children are settled before parents
    for final, arcs in states:
        below.append(int(final) + sum(below[t] for _, t in arcs))
    first, ends, label, target, skip = array("I"), bytearray(), bytearray(), array("I"), array("I")
    for final, arcs in states:
        first.append(len(label))
        ends.append(final)
        seen = int(final)
        for b, t in arcs:
            label.append(b)
            target.append(t)
            skip.append(seen)
            seen += below[t]
    first.append(len(label))
    start, ids = array("I", [0]), array("I")
    for word in words:
        ids.extend(entries[word])
        start.append(len(ids))
    head = struct.pack("<5I", root, len(states), len(label), len(words), len(ids))
    pad = lambda x: bytes(x) + b"\0" * (-len(x) % 4)
    body = b"".join([head, first.tobytes(), target.tobytes(), skip.tobytes(), start.tobytes(), ids.tobytes(), pad(ends), pad(label)])
    count = np.diff(np.frombuffer(first, np.uint32).astype(np.int64))
    keys = np.repeat(np.arange(len(states), dtype=np.int64) * 256, count) + np.frombuffer(label, np.uint8)
    return body + b"\0" * (-len(body) % 8) + keys.tobytes()


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, states, arcs, words, ids = struct.unpack_from("<5I", self.map)
        view, at = memoryview(self.map), 20
        parts = []
        for n in (states + 1, arcs, arcs, words + 1, ids):
            parts.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.first, self.target, self.skip, self.start, self.ids = parts
        self.ends = view[at : at + states]
        self.labels = at + states + -states % 4
        at = self.labels + arcs + -arcs % 4
        self.keys = np.frombuffer(self.map, np.int64, arcs, at + -at % 8) if arcs else np.zeros(0, np.int64)

    def get(self, word: bytes) -> tuple[int, ...] | None:
        state, place, find, labels = self.root, 0, self.map.find, self.labels
        for i in range(len(word)):
            low = labels + self.first[state]
            arc = find(word[i : i + 1], low, labels + self.first[state + 1])
            if arc < 0:
                return None
            arc -= labels
            place += self.skip[arc]
            state = self.target[arc]
        return tuple(self.ids[self.start[place] : self.start[place + 1]]) if self.ends[state] else None

    def get_many(self, words: list[bytes]) -> list[tuple[int, ...] | None]:
        """``get`` of each word; all walk the automaton side by side, a byte a step."""
        out: list[tuple[int, ...] | None] = [None] * len(words)
        if not words or not len(self.keys):
            return out
        size = np.fromiter(map(len, words), np.int64, len(words))
        letters, begin = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        target, skip, ends, start = np.frombuffer(self.target, np.uint32), np.frombuffer(self.skip, np.uint32), np.frombuffer(self.ends, np.uint8), self.start
        live, state, place, step = np.arange(len(words)), np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64), 0
        while len(live):
            over = size[live] == step
            for i, p in zip(live[over & (ends[state] > 0)].tolist(), place[over & (ends[state] > 0)].tolist(), strict=True):
                out[i] = tuple(self.ids[start[p] : start[p + 1]])
            live, state, place = live[~over], state[~over], place[~over]
            wanted = state * 256 + letters[begin[live] + step]
            arc = np.minimum(self.keys.searchsorted(wanted), len(self.keys) - 1)
            on = self.keys[arc] == wanted
            live, arc = live[on], arc[on]
            state, place, step = target[arc].astype(np.int64), place[on] + skip[arc], step + 1
        return out


class Memo:
    """Ids of words met lately: a full table becomes the older one and ages out."""

    def __init__(self, size: int) -> None:
        self.size, self.new, self.old = size, {}, {}

    def recall(self, key: str):
        ids = self.old.get(key)
        if ids is not None:
            self.keep(key, ids)
        return ids

    def keep(self, key: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        if len(self.new) >= self.size:
            self.old = self.new.copy()
            self.new.clear()
        if len(key) < 64:
            self.new[key] = ids
        return ids


class Encoder:
    """Texts to ids: lexicon first, merges for the rest, both remembered for a while.

    Where each gap of a text is one blank or one line feed, the split never crosses a
    gap: a blank goes with the word after it and a line feed stands alone. Such texts
    are cut at the gaps, and a chunk of letters, or of letters and one mark, needs no
    further split. Other chunks and texts take the split.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None) -> None:
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.words = Memo(MEMO)  # as the split gives them
        self.lettered = Memo(MEMO)  # letters only, without the blank that goes before
        self.marks = {c: vocabulary.merge(c.encode()) for c in ".,;:!?)"}

    def _word(self, word: str) -> tuple[int, ...]:
        ids = self.words.new.get(word) or self.words.recall(word)
        if ids is not None:
            return ids
        raw = word.encode()
        ids = self.lexicon.get(raw) if self.lexicon else None
        return self.words.keep(word, self.vocabulary.merge(raw) if ids is None else ids)

    def _letters(self, chunk: str) -> tuple[int, ...]:
        ids = self.lettered.new.get(chunk) or self.lettered.recall(chunk)
        if ids is not None:
            return ids
        raw = (" " + chunk).encode()
        ids = self.lexicon.get(raw) if self.lexicon else None
        return self.lettered.keep(chunk, self.vocabulary.merge(raw) if ids is None else ids)

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        if chunk.isalpha():
            return self._letters(chunk)
        mark = self.marks.get(chunk[-1])
        if mark is not None and chunk[:-1].isalpha():
            return (self.lettered.new.get(chunk[:-1]) or self._letters(chunk[:-1])) + mark
        return tuple(self._split(" " + chunk))

    def _split(self, text: str) -> list[int]:
        learn = self._word
        return list(itertools.chain.from_iterable([learn(w) for w in _SPLIT.findall(text)]))

    def _plain(self, text: str) -> list[int]:
        words = text.split()
        # as many gaps as blanks and line feeds, and every gap one character long
        if not words or len(words) != text.count(" ") + text.count("\n") + 1 or len(" ".join(words)) != len(text):
            return self._split(text)
        out: list[int] = []
        known, learn = self.lettered.new.get, self._chunk
        for i, line in enumerate(text.split("\n")):
            first, _, rest = line.partition(" ")
            out += self._split("\n") + self._split(first) if i else self._split(first)
            if rest:
                out.extend(itertools.chain.from_iterable([known(c) or learn(c) for c in rest.split(" ")]))
        return out

    def _piece(self, piece: str) -> tuple[int, ...]:
        """Ids of a chunk with the gap before it, a line feed or an unwritten blank."""
        return tuple(self._split(piece)) if piece[0] == "\n" else self._chunk(piece)

    def _meet(self, pieces: list[str]) -> None:
        """Learn the words of these pieces that were not met lately, all at once."""
        lettered, words = {}, {}
        for piece in pieces:
            if piece in self.lettered.new:
                continue
            stem = piece if piece[-1] not in self.marks else piece[:-1]
            if stem.isalpha():
                if stem not in lettered and len(stem) < 64 and not (self.lettered.new.get(stem) or self.lettered.recall(stem)):
                    lettered[stem] = " " + stem
            else:
                for word in _SPLIT.findall(piece if piece[0] == "\n" else " " + piece):
                    if word not in words and len(word) < 64 and not (self.words.new.get(word) or self.words.recall(word)):
                        words[word] = word
        raw = [w.encode() for w in itertools.chain(lettered.values(), words.values())]
        ids = self.lexicon.get_many(raw) if self.lexicon else [None] * len(raw)
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(rest, self.vocabulary.merge_many([raw[i] for i in rest]), strict=True):
            ids[i] = x
        for key, x in zip(lettered, ids):
            self.lettered.keep(key, x)
        for key, x in zip(words, ids[len(lettered) :], strict=True):
            self.words.keep(key, x)

    def encode_many(self, texts: pa.Array) -> pa.ListArray:
        """``encode`` of each text, as lists of int32; nulls are empty."""
        texts = pc.fill_null(texts, "")
        even = pc.invert(pc.match_substring_regex(texts, ODD))
        for special in self.vocabulary.special:
            even = pc.and_not(even, pc.match_substring(texts, special))
        # a piece is a chunk with its line feed, if one is before it; the first gets one, too
        plain = pc.replace_substring(texts.filter(even), "\n", " \n")
        cut = pc.split_pattern(pc.binary_join_element_wise("\n", plain, ""), " ")
        coded = cut.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        self._meet(pieces)
        known = self.lettered.new.get
        known_ids = [known(p) or self._piece(p) for p in pieces]
        found = _lists(known_ids).take(coded.indices)
        ends = found.offsets.to_numpy()[cut.offsets.to_numpy()]
        ids = np.delete(found.flatten().to_numpy(), ends[:-1])  # the line feed that was put first
        even = even.to_numpy(zero_copy_only=False)
        ids = pa.ListArray.from_arrays(pa.array(ends - np.arange(len(ends)), pa.int32()), pa.array(ids, pa.int32()))
        if even.all():
            return ids
        odd = _lists([self.encode(t) for t in texts.filter(pa.array(~even)).to_pylist()])
        place = np.empty(len(even), np.int64)
        place[np.flatnonzero(even)] = np.arange(even.sum())
        place[np.flatnonzero(~even)] = even.sum() + np.arange((~even).sum())
        return pa.concat_arrays([ids, odd]).take(pa.array(place))

    def encode(self, text: str) -> list[int]:
        special = self.vocabulary.special
        if not any(s in text for s in special):
            return self._plain(text)
        parts = self.vocabulary.cut.split(text)
        return [i for p in parts for i in ([special[p]] if p in special else self._plain(p))]


def _lists(runs: list) -> pa.ListArray:
    """Runs of ids as lists of int32."""
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs)))])
    ids = np.fromiter(itertools.chain.from_iterable(runs), np.int32, ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have some GROUP bytes."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)
    group = (np.cumsum(size) - size) // GROUP
    cuts = [*np.flatnonzero(np.diff(group, prepend=-1)), batch.num_rows]
    for at, end in itertools.pairwise(cuts):
        yield batch.slice(at, end - at)


def frequent_words(docs: DataFrame, min_share: float = MIN_SHARE) -> list[str]:
    """Runs of letters that occur at least ``min_share`` times per character of all texts.

    Every document counts. No more than 1 / min_share words can be as frequent, which
    bounds what comes to the driver. Tasks sum before the shuffle.
    """
    total = docs.select(F.sum(F.length("text"))).first()[0] or 0
    runs = docs.select(F.explode(F.split("text", r"[^\p{L}]+")).alias("word")).where("word <> '' and length(word) <= 40")
    counts = runs.groupBy("word").agg(F.count("*").alias("n"))
    return sorted(r.word for r in counts.where(F.col("n") >= F.lit(max(2.0, total * min_share))).select("word").collect())


def ship_lexicon(docs: DataFrame, vocabulary_path: str, min_share: float = MIN_SHARE) -> tuple[str, str]:
    """Compile the frequent words of ``docs`` and send them out with the vocabulary.

    Returns the names under which every executor finds the two files, also one
    that joins later. The lexicon holds each word with a blank before it.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        text = f.read()
    vocabulary = Vocabulary(text)
    entries = {w: vocabulary.merge(w) for w in ((" " + x).encode() for x in frequent_words(docs, min_share))}
    folder, names = tempfile.mkdtemp(), []
    for kind, data in (("lexicon", compile_lexicon(entries)), ("vocabulary", text.encode())):
        names.append(f"{kind}-{uuid.uuid4().hex}")
        with open(os.path.join(folder, names[-1]), "wb") as f:
            f.write(data)
        docs.sparkSession.sparkContext.addFile(os.path.join(folder, names[-1]))
    return names[0], names[1]


def _encoder(names: tuple[str, str]) -> Encoder:
    """This worker's encoder for the two files, kept for later tasks of this operator."""

    def make() -> Encoder:
        with open(SparkFiles.get(names[1]), encoding="utf-8") as f:
            return Encoder(Vocabulary(f.read()), Lexicon(SparkFiles.get(names[0])))

    return hold(names, make)


def encode_documents(docs: DataFrame, names: tuple[str, str]) -> DataFrame:
    """doc_id, ids array<int> of every whole text; a null text is empty and has none."""
    kept = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(names)
        for batch in batches:
            for few in _groups(batch):
                yield pa.RecordBatch.from_arrays([few.column(0), encoder.encode_many(few.column(1))], names=["doc_id", "ids"])

    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, names: tuple[str, str]) -> DataFrame:
    """doc_id, text from ``encode_documents``' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _encoder(names).vocabulary
        for batch in batches:
            texts = [vocabulary.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kept = encoded.select("doc_id", "ids")
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Encode and decode every text in one pass: doc_id, n_tokens and digests of both.

    ids_sha256 is over the decimal ids joined by commas, decoded_sha256 over the
    text that decoding the ids gives. Null texts are empty; repeated rows are rows
    of their own; no documents give no rows. Columns besides doc_id and text are
    not read.
    """
    kept = docs.select("doc_id", "text")
    digest = lambda s: hashlib.sha256(s).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(names)
        for few in itertools.chain.from_iterable(map(_groups, batches)):
            ids = encoder.encode_many(few.column(1))
            a = [digest(x) for x in encoder.vocabulary.decimals_many(ids)]
            b = [digest(x.encode()) for x in encoder.vocabulary.decode_many(ids)]
            columns = [few.column(0), pc.list_value_length(ids).cast(pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return kept.mapInArrow(
        run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
