"""Operator 13, alignment of two tokenizers' tokens by byte offsets, with a fast path for tokens of the same bytes.

Tokenizer A (byte-level BPE) and tokenizer B (pieces with byte fallback) cut the same bytes, a space and the text. Offsets where
tokens of both end cut them into groups; the last A token and the last B token of a group end together and are linked. Most
groups are one A token and one B token of the same bytes. For these a table from A id to the B id of the same bytes is made
beforehand, and their links are counted in vectors as long as A's vocabulary. Only the links of other groups enter the shuffle
of pairs, pre-aggregated. (The two never hold the same pair: tokens of the same bytes that end together start together.)

Neither tokenizer joins what stands before a space or line feed after a visible character with what follows: A's pre-tokens end
there, and no piece of B has a space after another character or a line feed (checked when the file is read). So a text is aligned
segment by segment. A worker keeps segments that it has aligned (and, when they are many, those met more than once); the libraries
encode new ones, many in one string, and what a text holds of each is counted in arrays. Where A's merges are those that the order
of its ids gives (checked when the file is read: every token's bytes alone become that token), plain characters go through the faster
of the two libraries for such files.

Defined results: null and empty texts have no tokens, and neither has a text whose tokens do not give back its bytes (one with
U+2581, which B reads as a space); texts of any length are aligned whole (a stretch without a space is one segment);
repeated rows get equal results and each counts; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from osseo.llm.bpe import PRE_TOKEN, Encoder, byte_alphabet, default_file
from osseo.llm.rows import map_texts, saved, spread_join, table, written

#: Segments that a worker keeps, and their characters.
STORED, STORED_CHARS = 250_000, 8_000_000
#: Characters of the longest segment that is encoded with others in one string, and of such a string.
SHORT, STRING = 200, 60_000
# A part begins with a space or line feed after a visible character, and runs to the next one.
_SEGMENT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*)?|\s+")
# Characters that every version of Unicode puts into the same classes of A's pre-tokens.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\u00c0-\u024f]*")
_SPACE = "▁"


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _places(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1 and so on, count[k] of them, for each k."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def _by_order(a_file: str):
    """An encoder that merges by the order of ids alone, or None where the file's merges might give other tokens.

    It takes a pair of tokens together if their bytes are a token, the lowest id first. Pairs that span a token's bytes arise in
    any text as they do from these bytes alone, so both agree if the file's merges turn the bytes of each token into it.
    """
    import tiktoken

    e = Encoder(a_file)
    made = [i for i, x in enumerate(e.bytes_of) if x and i not in {*e.special.values()}]
    if e.merged_beside([e.bytes_of[i] for i in made]) != [(i,) for i in made] or len({e.bytes_of[i] for i in made}) < len(made):
        return None
    if sorted(e.rank.values()) != sorted(e.rank.values(), key=lambda v: v[1]):
        return None
    return tiktoken.Encoding("ordered", pat_str=PRE_TOKEN, mergeable_ranks={e.bytes_of[i]: i for i in made}, special_tokens={})


class Aligner:
    """Both tokenizers, the bytes of their tokens, and ``same``, the B id of the same bytes for each A id (or -1).

    ``slots`` numbers the segments that are known; ``facts`` (tokens of A, of B, groups), ``groups`` and the links by segment are
    kept by that number. A segment without ``groups`` (None) does not give back its bytes.
    """

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        letters, vocab = byte_alphabet(), self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if letters.keys() >= set(token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.lengths = [np.array([len(x) for x in of], np.int64) for of in (self.a_bytes, self.b_bytes)]
        # where pieces never run over a space or line feed, segments can be aligned alone
        self.cuts = not any(_SPACE in p.lstrip(_SPACE) or "\n" in p for i, p in enumerate(pieces) if not self.b.is_byte(i))
        self.lone_space = self.b.piece_to_id(_SPACE)
        # pieces come before bytes of the same value, which stand for characters without a piece
        of_bytes = {x: i for i, x in reversed([*enumerate(self.b_bytes)]) if self.b.is_byte(i)}
        of_bytes |= {x: i for i, x in reversed([*enumerate(self.b_bytes)]) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))}
        self.same = np.array([of_bytes.get(x, -1) if x else -1 for x in self.a_bytes], np.int64)
        self.ordered = _by_order(a_file)
        self.slots: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str | None] = []
        self.uses = np.zeros(0, np.int64)
        self.facts = tuple(array("q") for _ in range(3))
        self.links = tuple(array("q") for _ in range(2))  # of the table of same bytes, and of other groups
        self.ends = tuple(array("q", [0]) for _ in range(2))

    def forget(self) -> None:
        """Keeps the segments that were met more than once, if these are fewer than half of what may be stored; else none."""
        names = [*self.slots]
        stay = np.flatnonzero(self.uses > 1)
        if len(stay) > STORED // 2 or sum(len(names[k]) for k in stay.tolist()) > STORED_CHARS // 2:
            stay = stay[:0]
        facts = np.array([np.array(v, np.int64)[stay] for v in self.facts])
        groups, links, counts = [self.groups[k] for k in stay.tolist()], [], []
        for held, end in zip(self.links, self.ends):
            held, end = np.array(held, np.int64), np.array(end, np.int64)
            counts.append(np.diff(end)[stay])
            links.append(held[_places(end[stay], counts[-1])])
        self.slots, self.chars, self.groups, self.uses = {}, 0, [], np.zeros(0, np.int64)
        self.facts, self.links, self.ends = tuple(array("q") for _ in range(3)), tuple(array("q") for _ in range(2)), tuple(array("q", [0]) for _ in range(2))
        self._add([names[k] for k in stay.tolist()], facts, groups, links, counts)

    def segments(self, text: str) -> list[str]:
        """``text`` with the space before it, in parts that can be aligned alone."""
        return _SEGMENT.findall(f" {text}") if self.cuts else [f" {text}"]

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of both for text that begins with a space or line feed; None if they do not give back its bytes."""
        if self.ordered is not None and _PLAIN.fullmatch(text):
            a = self.ordered.encode_ordinary(text)
        else:
            a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        if text == " ":
            b = [self.lone_space]
        else:  # B adds the space; before a line feed, that is a token of its own
            b = self.b.encode(text[1:], num_threads=1) if text[0] == " " else self.b.encode(text, num_threads=1)[1:]
        raw = text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def learn(self, new: list[str]) -> None:
        """Aligns segments; short ones that end in a visible character are encoded together, as a cut stands between them."""
        held: dict[bool, list[str]] = {True: [], False: []}
        size = {True: 0, False: 0}
        for s in new:
            if len(s) > SHORT or s[-1].isspace():
                self._align([s])
                continue
            plain = _PLAIN.fullmatch(s) is not None
            held[plain].append(s)
            size[plain] += len(s)
            if size[plain] >= STRING:
                self._align(held[plain])
                held[plain], size[plain] = [], 0
        for some in held.values():
            if some:
                self._align(some)

    def _align(self, segments: list[str]) -> None:
        ids = None if any(_SPACE in s for s in segments) else self.encoded("".join(segments))
        ends = np.cumsum([len(s.encode()) for s in segments])
        if ids is not None:
            at = [np.cumsum(n[x]) for n, x in zip(self.lengths, ids)]
            shared = np.intersect1d(*at, assume_unique=True)
        if ids is None or not np.isin(ends, shared).all():
            if len(segments) > 1:
                for s in segments:
                    self._align([s])
            else:
                self._add(segments, np.zeros((3, 1), np.int64), [None], [np.zeros(0, np.int64)] * 2, [np.zeros(1, np.int64)] * 2)
            return
        last = [np.searchsorted(x, shared) for x in at]
        size = [np.diff(x, prepend=-1) for x in last]
        x, y = (of[k] for of, k in zip(ids, last))
        of_group, n = np.searchsorted(ends, shared), len(segments)
        fast = (size[0] == 1) & (size[1] == 1) & (self.same[x] == y)
        both = [of.tolist() for of in ids]
        told = [f"{i}|{j}" for i, j in zip(x.tolist(), y.tolist())]
        for g in np.flatnonzero((size[0] > 1) | (size[1] > 1)).tolist():
            told[g] = "|".join(",".join(map(str, of[k[g] - c[g] + 1 : k[g] + 1])) for of, k, c in zip(both, last, size))
        cuts = np.searchsorted(of_group, np.arange(n + 1)).tolist()
        facts = [np.bincount(np.searchsorted(ends, of), minlength=n) for of in at] + [np.bincount(of_group, minlength=n)]
        links = [x[fast], x[~fast] * len(self.b_bytes) + y[~fast]]
        self._add(segments, np.array(facts), [";".join(told[i:j]) for i, j in zip(cuts, cuts[1:])], links, [np.bincount(of_group[k], minlength=n) for k in (fast, ~fast)])

    def _add(self, segments: list[str], facts: np.ndarray, groups: list, links: list[np.ndarray], counts: list[np.ndarray]) -> None:
        self.slots.update(zip(segments, range(len(self.groups), len(self.groups) + len(segments))))
        self.chars += sum(map(len, segments))
        self.groups += groups
        for k, new in zip(self.facts, facts):
            k.frombytes(new.astype(np.int64).tobytes())
        for held, end, new, n in zip(self.links, self.ends, links, counts):
            end.frombytes((np.cumsum(n) + end[-1]).astype(np.int64).tobytes())
            held.frombytes(new.astype(np.int64).tobytes())

    def counted(self, texts: list) -> dict[str, object]:
        """FACTS of each text, as arrays and lists."""
        if len(self.groups) > STORED or self.chars > STORED_CHARS:
            self.forget()
        cut = [self.segments(t) if t and _SPACE not in t else [] for t in texts]
        flat = [*chain.from_iterable(cut)]
        self.learn([*(set(flat) - self.slots.keys())])
        ids, n = np.fromiter(map(self.slots.__getitem__, flat), np.int64, len(flat)), len(texts)
        self.uses = np.pad(self.uses, (0, len(self.groups) - len(self.uses))) + np.bincount(ids, minlength=len(self.groups))
        of = np.repeat(np.arange(n), [*map(len, cut)])
        bad = np.array([g is None for g in self.groups], bool)
        if len(ids) and bad[ids].any():
            keep = np.bincount(of[bad[ids]], minlength=n)[of] == 0
            ids, of = ids[keep], of[keep]
        ends = np.searchsorted(of, np.arange(n + 1)).tolist()
        own, get = ids.tolist(), self.groups.__getitem__
        # each value is below 2**53, so sums of doubles are exact
        out: dict = {k: np.bincount(of, np.array(v, np.float64)[ids], n).astype(np.int64) for k, v in zip(("n_a", "n_b", "n_groups"), self.facts)}
        out["groups_sha256"] = [sha256(";".join(map(get, own[i:j])).encode()).hexdigest() if j > i else "" for i, j in zip(ends, ends[1:])]
        kinds, times = np.unique(of * max(len(self.groups), 1) + ids, return_counts=True)
        doc, slot = np.divmod(kinds, max(len(self.groups), 1))
        for name, held, end in zip(("same", "pairs"), self.links, self.ends):
            links, end = np.array(held, np.int64), np.array(end, np.int64)
            count = end[slot + 1] - end[slot]
            values, owner, weight = links[_places(end[slot], count)], np.repeat(doc, count), np.repeat(times, count)
            order = np.lexsort((values, owner))
            values, owner, weight = values[order], owner[order], weight[order]
            first = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])])) if len(values) else np.zeros(0, np.int64)
            lists = pa.array(np.searchsorted(owner[first], np.arange(n + 1)).astype(np.int32))
            sums = np.add.reduceat(weight, first) if len(first) else np.zeros(0, np.int64)
            out[name], out[f"{name}_n"] = (pa.ListArray.from_arrays(lists, pa.array(v.astype(np.int64))) for v in (values[first], sums))
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_file: str, b_file: str) -> Aligner:
    """The aligner of this Python worker for the two files."""
    if (a_file, b_file) not in _ALIGNERS:
        _ALIGNERS[a_file, b_file] = Aligner(a_file, b_file)
    return _ALIGNERS[a_file, b_file]


FACTS = {
    "n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "groups_sha256": T.StringType(),
    "same": T.ArrayType(T.LongType()), "same_n": T.ArrayType(T.LongType()), "pairs": T.ArrayType(T.LongType()), "pairs_n": T.ArrayType(T.LongType()),
}


def align(docs: DataFrame, a_file: str | None = None, b_file: str | None = None, text: str = "text") -> DataFrame:
    """Replaces the text by FACTS: numbers of tokens and groups, a hash of the groups, and the links with their numbers.

    ``same`` are A ids of links that the table of same bytes gives; ``pairs`` are other links as A id * B's size + B id.
    """
    files = a_file or default_file(), b_file or default_pieces()

    def batch(texts: list) -> dict:
        return aligner(*files).counted(texts)

    return map_texts(docs, FACTS, batch, text)


def same_counts(seen: DataFrame, size: int) -> np.ndarray:
    """How many links each A id has by the table of same bytes; each task sums one vector of ``size``, A's vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            np.add.at(total, batch.column("same").flatten().to_numpy(), batch.column("same_n").flatten().to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["a", "n"])

    rows = seen.select("same", "same_n").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).toPandas()  # A's vocabulary at most
    out = np.zeros(size, np.int64)
    out[rows.a.to_numpy(np.int64)] = rows.n.to_numpy(np.int64)
    return out


def _links(seen: DataFrame) -> DataFrame:
    """row, pair and n of the links of irregular groups."""
    return seen.select("row", F.explode(F.arrays_zip("pairs", "pairs_n")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.pairs_n").alias("n"))


def counted(seen: DataFrame, a_file: str | None = None, b_file: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of all links of ``seen``, the saved rows of ``align`` with a column ``row`` of their own.

    Gives (a, b, n, best) of links by the table of same bytes, at most one for each A id; (pair, n, best) of others; and (row,
    count_sum, n_best) for each row with links. ``best``: no other count of the B id is greater.
    """
    spark, known = seen.sparkSession, aligner(a_file or default_file(), b_file or default_pieces())
    size = len(known.b_bytes)
    links = _links(seen)
    pairs = saved(links.groupBy("pair").agg(F.sum("n").alias("n")))
    ids, of_a = known.same, same_counts(seen, len(known.same))
    top = np.zeros(size, np.int64)
    np.maximum.at(top, ids[of_a > 0], of_a[of_a > 0])
    others = pairs.groupBy((F.col("pair") % size).alias("b")).agg(F.max("n").alias("n")).toPandas()  # B's vocabulary at most
    np.maximum.at(top, others.b.to_numpy(np.int64), others.n.to_numpy(np.int64))
    vector = lambda x: spark.sparkContext.broadcast(np.asarray(x, np.int64))
    count, best = vector(of_a), vector((of_a > 0) & (of_a == top[ids]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, n = (batch.column(c).flatten().to_numpy() for c in ("same", "same_n"))
            of = np.repeat(np.arange(batch.num_rows), batch.column("same").value_lengths().to_numpy())
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            for out, each in zip(sums, (count.value, best.value)):
                np.add.at(out, of, n * each[a])
            yield pa.RecordBatch.from_arrays([batch.column("row"), *map(pa.array, sums)], names=["row", "count_sum", "n_best"])

    fast = seen.select("row", "same", "same_n").mapInArrow(run, "row long, count_sum long, n_best long")
    tops = spark.createDataFrame([(b, n) for b, n in enumerate(top.tolist())], "b long, top long")  # as long as B's vocabulary
    rated = saved(pairs.withColumn("b", F.col("pair") % size).join(F.broadcast(tops), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best")))
    slow = spread_join(links.withColumnRenamed("n", "times"), rated.withColumn("count", F.col("n")), ["pair"])
    slow = slow.groupBy("row").agg(F.sum(F.col("times") * F.col("count")).alias("count_sum"), F.sum(F.col("times") * F.col("best").cast("long")).alias("n_best"))
    by_row = fast.unionByName(slow).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    used = np.flatnonzero(of_a)
    regular = spark.createDataFrame([*zip(used.tolist(), ids[used].tolist(), of_a[used].tolist(), best.value[used].astype(bool).tolist())], "a long, b long, n long, best boolean")
    return regular, rated, by_row


def link_table(seen: DataFrame, a_file: str | None = None, b_file: str | None = None) -> DataFrame:
    """a, b, n and best of all pairs of ids that are linked somewhere; ``seen`` as for ``counted``."""
    regular, rated, _ = counted(seen, a_file, b_file)
    size = len(aligner(a_file or default_file(), b_file or default_pieces()).b_bytes)
    return regular.unionByName(rated.select(F.expr(f"pair div {size}").alias("a"), (F.col("pair") % size).alias("b"), "n", "best"))


def kept(docs: DataFrame, a_file: str | None = None, b_file: str | None = None) -> DataFrame:
    """The rows of ``align`` with a number of their own, by way of Parquet."""
    return written(align(docs.withColumn("row", F.monotonically_increasing_id()), a_file, b_file))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = kept(table(spark, sf_dir, "documents").select("doc_id", "text"))
    by_row = counted(seen)[2]
    sums = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum"))
    return seen.join(by_row, "row", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), *sums, "groups_sha256")
