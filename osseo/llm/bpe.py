"""Operator 5, BPE encoding and decoding as a bounded-lookahead streaming transducer.

``Transducer`` takes a text in pieces and gives token ids as soon as they are stable. Two boundaries make them so. A pre-token
(word, number, run of signs or of white space) is final once the text goes on HOLD characters beyond its end. A pre-token that
is longer than a piece is not waited for: from the merge list the encoder computes a sufficient lookahead, how many bytes
beyond a token must be known before no further text can change it; tokens that end before the lookahead leave. So the state
is a tail, an open buffer of STEP bytes plus the lookahead, and bounded stores of known transitions, however long the text is.
``Decoder`` is the inverse state machine: bytes of token ids go through an incremental UTF-8 decoder.

Why the lookahead suffices: more text on the right can only change a buffer's tokens through a chain of merges of rising
rank, each of which takes the symbol at the frontier (a symbol that differs between the two readings) as its right part, or
grows it rightwards. One pass over the merges in rank order gives the furthest left that any such chain reaches.

The pre-tokens of a step that are not known yet are merged side by side, as columns of one array, round by round.

Defined results: a null or empty text has no token and decodes to the empty text; texts of any length are encoded whole;
repeated rows encode alike; strings of the file's special tokens in a text become those tokens, as the library's default
does; further columns pass through.
"""

from __future__ import annotations

import codecs
import heapq
import json
from array import array
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from osseo.llm.rows import map_texts, table

# Fixed value: the pre-token pattern of byte-level BPE files that have use_regex set.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# What goes on with an open pre-token: its kind of character.
KINDS = [r"\p{L}*", r"\p{N}*", r"\s*", r"[^\s\p{L}\p{N}]*"]
#: Characters of a text that one step reads.
PIECE = 65_536
#: Characters at the end of what is known that may still change pre-tokens before them (special strings are held as well).
HOLD = 4
#: Bytes that an open buffer holds besides the lookahead.
STEP = 512
#: Characters from which an unfinished pre-token is opened.
OPEN = 1_024
#: Pre-tokens that a worker keeps with their ids (and as many of an older generation, which goes when these are full).
STORED_WORDS = 150_000
#: Bytes of the longest pre-tokens that are merged side by side.
_SHORT = 48
_NEVER = 1 << 62


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the file's tokens."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: Iterable[tuple[bytes, bytes]]) -> int:
    """Bytes beyond a buffer position that decide all tokens which end there or before; merges in rank order."""
    reach: dict[bytes, int] = {}
    for left, right in merges:
        here = max(len(left), reach.get(left, 0), reach[right] + len(left) if right in reach else 0)
        for symbol in (left, left + right):
            reach[symbol] = max(reach.get(symbol, 0), here)
    return max(reach.values(), default=1)


class Encoder:
    """The tables of a tokenizer file, and the tokens of byte strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.of_byte = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        self.rank = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: raw(t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.bytes_of = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.pairs = np.array(sorted((a << 32 | b) for a, b in self.rank), np.int64)
        order = [self.rank[p >> 32, p & 0xFFFFFFFF] for p in self.pairs.tolist()]
        self.ranks = np.array([k for k, _ in order], np.int64)
        self.into = np.zeros(len(merges), np.int64)
        self.into[self.ranks] = [t for _, t in order]
        self.lookahead = sufficient_lookahead([(raw(a), raw(b)) for a, b in merges])
        self.longest = max(map(len, self.bytes_of))
        self.pre_token = regex.compile(PRE_TOKEN)
        self.kinds = [regex.compile(k) for k in KINDS]
        self.splits = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.hold = max([HOLD, *(len(s) + 2 for s in self.special)])
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.same = list(range(len(self.bytes_of)))  # one object per id, however often it is kept

    def learn(self, words: Iterable[str]) -> None:
        """Makes the ids of all ``words`` known."""
        if len(self.known) >= STORED_WORDS:
            self.older, self.known = self.known, {}
        new = [w for w in set(words) - self.known.keys() if (ids := self.older.get(w)) is None or self.known.setdefault(w, ids) is None]
        coded = [w.encode() for w in new]
        short = [k for k, c in enumerate(coded) if len(c) <= _SHORT]
        self.known.update(zip((new[k] for k in short), self.merged_beside([coded[k] for k in short])))
        self.known.update((w, tuple(self.merged(c))) for w, c in zip(new, coded) if len(c) > _SHORT)

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, or _NEVER."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], _NEVER)

    def merged_beside(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """``merged`` for many short words: each round makes the next merge of every word that has one."""
        if not words or not len(self.pairs):
            return [tuple(self.of_byte[list(w)].tolist()) for w in words]
        ids = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        size = np.array([len(w) for w in words])
        first = np.cumsum(size) - size
        rank = np.full(len(ids), _NEVER)
        rank[:-1] = self.ranked(ids[:-1], ids[1:])
        rank[first + size - 1] = _NEVER
        live = np.arange(len(words))
        while len(live):
            # words between live ones have no pair left, so they may lie in a live word's segment
            low = np.minimum.reduceat(rank, first[live])
            live, low = live[low < _NEVER], low[low < _NEVER]
            if not len(live):
                break
            hit = np.flatnonzero(rank == _spread(low, first[live], len(rank)))
            at = hit[np.searchsorted(hit, first[live])]  # the leftmost one of each word
            ids[at] = self.into[low]
            gone = np.ones(len(ids), bool)
            gone[at + 1] = False
            ids, rank = ids[gone], rank[gone]
            at -= np.arange(len(at))
            removed = np.zeros(len(words), np.int64)
            removed[live] = 1
            size = size - removed
            first = np.cumsum(size) - size
            end = at == first[live] + size[live] - 1
            inner = at[~end]
            rank[at[end]] = _NEVER
            rank[inner] = self.ranked(ids[inner], ids[inner + 1])
            before = at[at > first[live]]
            rank[before - 1] = self.ranked(ids[before - 1], ids[before])
        flat = [*map(self.same.__getitem__, ids.tolist())]
        return [tuple(flat[a:b]) for a, b in zip(first.tolist(), (first + size).tolist())]

    def merged(self, data: bytes) -> list[int]:
        """Ids after all merges within ``data``, the lowest rank first and the leftmost among equals."""
        ids = [self.same[i] for i in self.of_byte[np.frombuffer(data, np.uint8)].tolist()]
        rank, n = self.rank, len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        waiting = [(rank[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heapq.heapify(waiting)
        while waiting:
            _, i, a, b = heapq.heappop(waiting)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = rank[a, b][1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y >= 0 and (ids[x], ids[y]) in rank:
                    heapq.heappush(waiting, (rank[ids[x], ids[y]][0], x, ids[x], ids[y]))
        return [t for t in ids if t >= 0]


def _spread(values: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """values[k] from first[k] to first[k + 1] (the first ones also before, the last ones up to n)."""
    return np.repeat(values, np.diff(np.concatenate([[0], first[1:], [n]])))


class Transducer:
    """Token ids of one text that comes in pieces."""

    def __init__(self, encoder: Encoder):
        self.e, self.tail = encoder, ""
        self.kind: regex.Pattern | None = None  # of the open pre-token
        self.buffer = b""  # its bytes whose tokens are not stable

    def feed(self, text: str, last: bool = False) -> list[int]:
        """The ids that are stable once ``text`` is known; with ``last`` all that are left."""
        parts = self.cut(text, last)
        self.e.learn(chain.from_iterable(words for words, _ in parts))
        return self.ids(parts)

    def ids(self, parts: list[tuple[list[str], list[int]]]) -> list[int]:
        """The ids of what ``cut`` gave; its words must be known."""
        out: list[int] = []
        for words, ids in parts:
            out.extend(chain.from_iterable(map(self.e.known.__getitem__, words)))
            out += ids
        return out

    def cut(self, text: str, last: bool = False) -> list[tuple[list[str], list[int]]]:
        """Final pre-tokens, and ids after them that are stable already (of special strings and of open pre-tokens)."""
        e, out, at = self.e, [], 0
        if self.tail:
            text = self.tail + text
        if e.splits is not None:
            for m in e.splits.finditer(text):
                self._words(text[at : m.start()], True, out)
                out.append(([], [e.special[m[0]]]))
                at = m.end()
        self.tail = self._words(text[at:] if at else text, last, out)
        return out

    def _words(self, text: str, last: bool, out: list) -> str:
        """Adds the final pre-tokens of ``text`` to ``out`` and returns the rest; ``last``: nothing follows ``text``."""
        e, sure = self.e, len(text) if last else len(text) - self.e.hold
        if self.kind is not None:
            run = self.kind.match(text).end()
            more = run - (self.kind is e.kinds[2] and run < len(text))  # white space leaves its last character to a word
            if not last and more > sure - 1:
                out.append(([], self._go_on(text[: max(sure - 1, 0)])))
                return text[max(sure - 1, 0) :]
            out.append(([], self._go_on(text[:more]) + e.merged(self.buffer)))
            self.kind, self.buffer, text, sure = None, b"", text[more:], sure - more
        words, end, word = e.pre_token.findall(text), len(text), ""
        while words and end > sure:
            word = words.pop()
            end -= len(word)
        out.append((words, []))
        if last or sure - end < OPEN:
            return text[end:]
        self.kind = next(k for k in (e.kinds[2], e.kinds[0], e.kinds[1], e.kinds[3]) if k.fullmatch(word[-1]))
        out.append(([], self._go_on(text[end : sure - 1])))
        return text[sure - 1 :]

    def _go_on(self, text: str) -> list[int]:
        """Appends to the open pre-token; its tokens that end before the lookahead leave."""
        e, data, out = self.e, self.buffer + text.encode(), []
        at, step = 0, max(STEP, e.longest)
        while len(data) - at > step + e.lookahead:
            stable = at + step
            for t in e.merged(data[at : stable + e.lookahead]):
                if at + len(e.bytes_of[t]) > stable:
                    break
                out.append(t)
                at += len(e.bytes_of[t])
        self.buffer = data[at:]
        return out


class Decoder:
    """Token ids to text, piece by piece; incomplete characters wait, impossible bytes become U+FFFD."""

    def __init__(self, bytes_of: list[bytes]):
        self.bytes_of = bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int], last: bool = False) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)), last)

    def text(self, ids: list[int], step: int = 8192) -> str:
        out = [self.feed(ids[k : k + step]) for k in range(0, len(ids), step)]
        return "".join([*out, self.feed([], last=True)])


class Digest:
    """Number of ids, and hashes of the ids and of their text, from ids that come in pieces."""

    def __init__(self, encoder: Encoder):
        self.e, self.n, self.ids, self.text, self.decoder = encoder, 0, sha256(), sha256(), Decoder(encoder.bytes_of)

    def feed(self, ids: list[int]) -> None:
        if ids:
            self.ids.update(("," * (self.n > 0) + ",".join(map(self.e.text_of.__getitem__, ids))).encode())
            self.text.update(self.decoder.feed(ids).encode())
            self.n += len(ids)

    def end(self) -> tuple[int, str, str]:
        self.text.update(self.decoder.feed([], last=True).encode())
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker for that file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


DIGESTS = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}


def coded(docs: DataFrame, path: str | None = None, text: str = "text", ids: str | None = None, digests: bool = False) -> DataFrame:
    """Replaces the text by its token ids (an array of int named ``ids``) or by DIGESTS, or both; ids and hashes are made in pieces."""
    path = path or default_file()
    added = ({ids: T.ArrayType(T.IntegerType())} if ids else {}) | (DIGESTS if digests else {})

    def batch(texts: list) -> dict:
        e = encoder(path)
        found, digests_of = [array("i") for _ in texts], [Digest(e) for _ in texts]
        open_ones = [(k, Transducer(e)) for k in range(len(texts))]
        at = 0
        while open_ones:  # one piece of every text that goes on
            cut = [t.cut((texts[k] or "")[at : at + PIECE], at + PIECE >= len(texts[k] or "")) for k, t in open_ones]
            e.learn(chain.from_iterable(words for parts in cut for words, _ in parts))
            for (k, t), parts in zip(open_ones, cut):
                got = t.ids(parts)
                if ids:
                    found[k].extend(got)
                if digests:
                    digests_of[k].feed(got)
            at += PIECE
            open_ones = [(k, t) for k, t in open_ones if at < len(texts[k] or "")]
        out: dict = dict(zip(DIGESTS, zip(*(d.end() for d in digests_of)))) if digests else {}
        if ids:
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            out[ids] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.frombuffer(f, np.int32) for f in found])))
        return out

    return map_texts(docs, added, batch, text)


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replaces each text by the array of its token ids."""
    return coded(docs, path, text, ids)


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of each array of token ids (null: empty)."""
    path = path or default_file()
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of = encoder(path).bytes_of
        for batch in batches:
            arrays, at = batch.column(ids), 0
            while at < len(arrays):  # a few rows at a time: their ids are Python objects meanwhile
                part = arrays.slice(at, 256)
                texts = [Decoder(table_of).text(x.tolist()) if x is not None else "" for x in part.to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, 256) for c in batch.columns), pa.array(texts, pa.string())], names=[*batch.schema.names, text])
                at += 256

    return df.mapInArrow(run, schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True).select("doc_id", *DIGESTS)
