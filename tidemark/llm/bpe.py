"""Byte-level BPE as a lazily determinised finite-state transducer.

Merges by rank have a left-to-right form: every prefix of a string has exactly one last token, and a token
may follow another only if their concatenation, merged by rank, gives back just these two. So while bytes
come in, the possible token boundaries form a chain of last tokens, of which only those ends matter that a
longer token could still cover. What all of them share is certain and is emitted; the rest waits. The wait
is bounded: a boundary stops mattering once no vocabulary entry continues over it, which is the longest
entry's length at the latest.

A state of the transducer is (last emitted token, bytes that wait). States and their transitions, and the
flush at the end of a piece, are worked out when they are needed again and then looked up, one lookup per
byte; at ``MAX_STATES`` the machine starts again empty, which costs time but changes no result.
Each match of the pre-tokenising pattern is one run of the machine from its start state; a bounded table of
short whole matches stands in front of it. Unless ``keep`` is set, a codec goes at its task's end, since reused workers
would carry it into later stages.

Decoding concatenates token bytes; ``Utf8Stream`` turns chunks into text with an incremental UTF-8 state
machine that holds back at most three bytes.

Defined results: null text: no tokens; lone surrogates cannot occur in a Spark string; an empty table: no
rows; extra columns are kept by ``encode`` unless they have its result's names, which it replaces.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.memory import tidy

MAX_STATES = 200_000
MAX_PAIRS = 400_000
MAX_MATCHES = 400_000
SHORT = 32
BYTES = [bytes([k]) for k in range(256)]
End = tuple[dict, int, tuple[int, ...]]


class Ranks:
    """A vocabulary of ranks, the beginnings of its entries, and which entry may follow which."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.size = list(map(len, self.tokens))
        #: The trie of the entries. A node has for each byte the rank of the entry that ends there (-1: none) and the
        #: next node, None where no entry goes on.
        self.trie = self._trie(ranks)
        self._seam: tuple[dict, dict] = ({}, {})
        self.known_pairs: dict[int, bool] = {}

    @staticmethod
    def _trie(ranks: dict[bytes, int]) -> dict[int, tuple[int, dict | None]]:
        root: dict[int, tuple[int, dict | None]] = {}
        for token in sorted(ranks, key=len):
            node = root
            for byte in token[:-1]:
                rank, more = node.get(byte, (-1, None))
                if more is None:
                    node[byte] = (rank, more := {})
                node = more
            node[token[-1]] = (ranks[token], node.get(token[-1], (-1, None))[1])
        return root

    def merge(self, value: bytes, left: int = 1) -> list[bytes]:
        """Merge by rank until ``left`` parts remain or nothing merges."""
        parts = [value[k : k + 1] for k in range(len(value))]
        while len(parts) > left:
            best = min(range(len(parts) - 1), key=lambda k: (self.ranks.get(parts[k] + parts[k + 1], 1 << 40), k))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def seam(self, rank: int, side: int) -> list[tuple[bytes, int]] | None:
        """The parts at one end (0: start, 1: end) of an entry while it is merged, oldest last, and when each
        came to be (a byte: -1). None for an entry that merging never makes."""
        known = self._seam[side]
        if rank not in known:
            at, out = self.tokens[rank], []
            while at is not None and len(at) > 1:
                out.append((at, self.ranks[at]))
                parts = self.merge(at, 2)
                at = parts[-side] if len(parts) == 2 else None
            known[rank] = None if at is None else [*out, (at, -1)]
        return known[rank]

    def follows(self, left: int, right: int) -> bool:
        """Whether merging the two entries' bytes gives just these two (``left`` -1: whether ``right`` alone does):
        no two parts that meet at the border at any time merge there before one of them is used up inside its
        own entry."""
        key = left << 24 | right
        if (known := self.known_pairs.get(key)) is None:
            if len(self.known_pairs) >= MAX_PAIRS:
                self.known_pairs.clear()
            known = self.known_pairs[key] = self._apart(self.seam(left, 1) if left >= 0 else (), self.seam(right, 0))
        return known

    def _apart(self, left: list[tuple[bytes, int]] | None, right: list[tuple[bytes, int]] | None) -> bool:
        if left is None or right is None:
            return False
        i, j, until, ranks = 0, 0, 1 << 40, self.ranks  # backwards in time: the newer of the two parts is taken apart
        while i < len(left) and j < len(right):
            (a, made_a), (b, made_b) = left[i], right[j]
            if ranks.get(a + b, 1 << 40) < until:
                return False
            if made_a > made_b:
                until, i = made_a, i + 1
            else:  # at one rank the leftmost merge comes first, so one across the border goes before this one
                until, j = made_b + 1, j + 1
        return True


class Transducer:
    """States are numbered as they turn up. A state is named by the last emitted id and the bytes that wait, and
    keeps its live ends: for every place from where an entry may still go on past the last byte, that entry's
    node in the trie, the id that ends at the place, and the ids up to there that are not emitted.

    A transition becomes a state's arc the second time it is needed. The first time, the rest of the piece
    runs through the same steps without naming states, so words that occur once leave no states behind."""

    def __init__(self, ranks: Ranks, share: float = 1.0):
        self.r, self.share = ranks, share
        self._reset()

    def _reset(self, start: tuple | None = None) -> int:
        """Empty tables but for the start state and, if given, the state to go on from; returns its number."""
        self.key: list[tuple[int, bytes]] = []  # (last emitted id, bytes that wait)
        self.live: list[list[End]] = []
        self.number: dict[tuple[int, bytes], int] = {}
        self.next: dict[int, tuple[int, tuple[int, ...]]] = {}  # state << 8 | byte: state, emitted ids
        self.once: set[int] = set()
        self._state((-1, b""), [(self.r.trie, -1, ())])
        return self._state(*start) if start else 0

    def _state(self, key: tuple[int, bytes], live: list) -> int:
        if (at := self.number.get(key)) is None:
            at = self.number[key] = len(self.key)
            self.key.append(key)
            self.live.append(live)
        return at

    def _ends(self, live: list[End], byte: int) -> list[End]:
        """The live ends one byte on; the last one is at the byte's end."""
        known, made, out = self.r.known_pairs, None, []
        for node, last, chain in live:
            if (to := node.get(byte)) is not None:
                rank, more = to
                if more is not None:
                    out.append((more, last, chain))
                if made is None and rank >= 0:
                    if (fits := known.get(last << 24 | rank)) is None:
                        fits = self.r.follows(last, rank)
                    if fits:
                        made = (self.r.trie, rank, (*chain, rank))  # the one entry that may come last
        out.append(made)
        return out

    @staticmethod
    def _sure(live: list[End]) -> tuple[int, ...]:
        """What all chains begin with: it is certain."""
        sure = live[0][2]
        for _, _, c in live:
            if not sure:
                break
            while c[: len(sure)] != sure:
                sure = sure[:-1]
        return sure

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        before, wait = self.key[state]
        live = self._ends(self.live[state], byte)
        wait += BYTES[byte]
        if sure := self._sure(live):
            shared, size = len(sure), self.r.size
            wait = wait[sum([size[t] for t in sure]) :]
            before = sure[-1]
            live = [(node, last, c[shared:]) for node, last, c in live]
        return self._state((before, wait), live), sure

    def _unnamed(self, state: int, rest: bytes, out: list[int]) -> list[int]:
        """The ids of the rest of a piece, without states; what is certain leaves the chains every few entries."""
        live, trie, known, follows = self.live[state], self.r.trie, self.r.known_pairs, self.r.follows
        for byte in rest:
            out_, made = [], None
            for node, last, chain in live:  # as in _ends
                if byte in node:
                    rank, more = node[byte]
                    if more is not None:
                        out_.append((more, last, chain))
                    if rank >= 0 and made is None:
                        fits = known.get(last << 24 | rank)
                        if fits or fits is None and follows(last, rank):
                            made = (trie, rank, (*chain, rank))
            out_.append(made)
            live = out_
            if len(made[2]) > 8 and (sure := self._sure(live)):
                out.extend(sure)
                shared = len(sure)
                live = [(node, last, c[shared:]) for node, last, c in live]
        out.extend(live[-1][2])
        return out

    def run(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        if len(self.key) > self.share * MAX_STATES or len(self.once) > 4 * self.share * MAX_STATES:
            self._reset()
        out: list[int] = []
        state, table = 0, self.next
        for at, byte in enumerate(piece):
            arc = state << 8 | byte
            found = table.get(arc)
            if found is None:
                if arc not in self.once:
                    self.once.add(arc)
                    return self._unnamed(state, piece[at:], out)
                found = table[arc] = self._step(state, byte)
            state, ids = found
            if ids:
                out.extend(ids)
        out.extend(self.live[state][-1][2])
        return out


assert array("I").itemsize == 4 and sys.byteorder == "little"  # noqa: S101


class Codec:
    """Encode and decode whole texts; memory is bounded by the tables' limits and the text itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, share: float = 1.0):
        self.ranks, self.share = Ranks(ranks), share  # share: of the tables' limits
        self.machine = Transducer(self.ranks, share)
        self.split = regex.compile(pattern)
        self.seen: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # the table that ``seen`` followed: what is still in use moves over

    def _ids(self, match: str) -> bytes:
        if (ids := self.before.get(match)) is not None:
            self.seen[match] = ids
            return ids
        piece = match.encode()
        whole = self.ranks.ranks.get(piece)  # an entry that is a whole match stands for itself
        ids = array("I", self.machine.run(piece) if whole is None else [whole]).tobytes()
        if len(match) <= SHORT:
            if len(self.seen) >= self.share * MAX_MATCHES:
                self.before, self.seen = self.seen, {}
            self.seen[match] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        seen, ids = self.seen, self._ids
        return b"".join([seen.get(m) or ids(m) for m in self.split.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.ranks.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decoded(self, ids: bytes) -> str:
        """Text of ids, through the incremental decoder, some thousands of them at a time."""
        stream = Utf8Stream()
        parts = [stream.feed(self.decode(ids[at : at + 16_384])) for at in range(0, len(ids), 16_384)]
        return "".join([*parts, stream.close()])

    def decode_text(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes certain, id by id."""
        stream = Utf8Stream()
        for k in ids:
            if out := stream.feed(self.ranks.tokens[k]):
                yield out
        if out := stream.close():
            yield out


class Utf8Stream:
    """UTF-8 in chunks: bytes of an unfinished character wait in the state, at most three of them."""

    def __init__(self) -> None:
        self.wait = b""

    @staticmethod
    def _open(data: bytes) -> int:
        """How many bytes at the end begin a character that may still be completed."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead < 0x80 or lead > 0xF4:
                return 0
            if lead >= 0xC2:
                need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                if back >= need:
                    return 0
                if back > 1:
                    low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
                    if not low <= data[1 - back] <= high:
                        return 0
                return back
            if lead >= 0xC0:
                return 0
        return 0

    def feed(self, chunk: bytes) -> str:
        data = self.wait + chunk
        held = self._open(data)
        self.wait = data[len(data) - held :] if held else b""
        return data[: len(data) - held].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.wait = self.wait.decode("utf-8", "replace"), b""
        return out


#: Of the tables' limits, for codecs that live for a task.
SMALL = 0.2


@lru_cache(maxsize=1)
def codec(path: str, pattern: str, share: float = 1.0) -> Codec:
    """One codec per worker process; the vocabulary file is read on the executor that needs it."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return Codec(ranks, pattern, share)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", digest: Callable[[Codec, bytes], list] | None = None, digest_schema: str = "", keep: bool = False, check: bool = False) -> DataFrame:
    """Add ``n_tokens`` and ``token_ids`` (little-endian uint32 bytes) to every row, or a digest of them.

    One narrow pass: no shuffle, rows stream through Arrow batches. A codec lives for a task, with small tables. With
    ``keep`` it serves a worker's next tasks too, with larger ones: quicker where nothing but encoding follows, but
    its memory (bounded, some 300 MB) stays with the worker. With ``check`` every text is decoded again and must be the same.
    """
    made = digest_schema or "n_tokens long, token_ids binary"
    names = [x.split()[0] for x in made.split(",")]
    kept = [f for f in docs.schema.fields if f.name not in names and (f.name != text or not digest)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [made])
    docs = docs.select(*[f"`{f.name}`" for f in kept], *([f"`{text}`"] if text not in [f.name for f in kept] else []))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = codec(path, pattern, 1.0 if keep else SMALL)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows = []
                for value in part.column(text):
                    said = value.as_py() or ""
                    ids = machine.encode(said)
                    if check and machine.decoded(ids) != said:
                        raise ValueError("token ids do not decode to their text")
                    rows.append(digest(machine, ids) if digest else [len(ids) // 4, ids])
                columns = [pa.array(list(x)) for x in zip(*rows, strict=True)]
                yield pa.record_batch([*[part.column(f.name) for f in kept], *columns], names=[*[f.name for f in kept], *names])

    return docs.mapInArrow(tidy(work, None if keep else lambda: codec.cache_clear()), schema)
