"""Operator 1, language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language in Spark (partial counts per partition, then a sum per language and bucket); the
log-probability matrix, languages x buckets, is broadcast and each batch is scored as a sparse row times that matrix.

Defined results: a null text or one without any letter gets ``und`` and score 0; ties go to the language that sorts first;
a very long text counts whole, in steps that change no result; repeated rows are predicted alike; without any training row all texts get ``und``;
a null doc_id is neither held out nor learned from; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from osseo.llm import rows
from osseo.llm.rows import bounded_sample, chunks, map_texts, table

BUCKETS = 1 << 16
#: Labelled rows that the fit reads at most (in expectation; chosen by a hash of doc_id).
TRAIN_ROWS = 20_000
#: Bytes that the broadcast matrix may have.
MODEL_BYTES = 256 << 20
_LETTER = regex.compile(r"\p{L}")
#: Log-probabilities are kept as integers in this unit, so that sums over a text are exact in any order.
UNIT = 1 << 20


def ngrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bigrams and trigrams by steps of positions: their buckets, and where those of each text begin and end in the step.

    Texts are lower-cased and padded by a space before and two after, so that no n-gram spans two texts. A step holds
    CHUNK_CHARS positions at most, and n-grams across steps are whole, so the size of a step changes no sum over them.
    """
    blocks = [f" {t.lower()}  " for t in texts]
    c = np.frombuffer("".join(blocks).encode("utf-32-le"), np.uint32)
    off = np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype(np.int64)
    for lo in range(0, len(c), rows.CHUNK_CHARS):
        part = c[lo : lo + rows.CHUNK_CHARS + 2]
        two = part[:-1] * np.uint32(0x9E3779B1) + part[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] + part[2:] * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F)
        for h, n in ((two, 2), (three, 3)):
            h = h[: rows.CHUNK_CHARS]
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            yield (h ^ (h >> np.uint32(13))) & np.uint32(BUCKETS - 1), np.clip(off[:-1] - lo, 0, len(h)), np.clip(off[1:] - n + 1 - lo, 0, len(h))


def train(labelled: DataFrame, alpha: float = 0.1, train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, and their log-probabilities (in UNIT) by bucket with the log prior as the last row; ``labelled`` has doc_id, text, lang."""
    sample = bounded_sample(labelled.where("text IS NOT NULL AND lang IS NOT NULL"), "doc_id", train_rows).select("lang", "text")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lo, hi, texts in chunks(batch.column("text").to_pylist()):
                own = langs[lo:hi]
                for bucket, first, end in ngrams(texts):
                    for lang in set(own):
                        into = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                        into[:BUCKETS] += np.bincount(np.concatenate([bucket[f:e] for f, e, o in zip(first, end, own, strict=True) if o == lang]), minlength=BUCKETS)
                for i in range(lo, hi):
                    sums[langs[i]][BUCKETS] += 1
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

    counts = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    per_lang = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("b"))  # at most BUCKETS + 1 entries each
    got = {r.lang: r.b for r in per_lang.toLocalIterator()}
    langs = sorted(got)
    if len(langs) * (BUCKETS + 1) * 4 > MODEL_BYTES:
        raise ValueError(f"{len(langs)} languages need more than {MODEL_BYTES} bytes; use fewer buckets")
    n = np.zeros((BUCKETS + 1, len(langs)))
    for k, lang in enumerate(langs):
        for bucket, times in got[lang]:
            n[bucket, k] = times
    docs, grams = n[BUCKETS], n[:BUCKETS] + alpha
    return langs, np.rint(UNIT * np.vstack([np.log(grams / grams.sum(0)), np.log(docs / docs.sum())[None]])).astype(np.int32) if langs else np.zeros((BUCKETS + 1, 0), np.int32)


#: Sums of log-probabilities (positions times languages) that one step holds.
SUMS = 2_000_000


def score(texts: list, langs: list[str], logp: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and its posterior probability for each text."""
    total = np.repeat(logp[BUCKETS][None].astype(np.int64), len(texts), 0)
    step = max(SUMS // max(len(langs), 1), 1)
    for bucket, first, end in ngrams([t or "" for t in texts]):
        for at in range(0, len(bucket), step):
            part = logp[bucket[at : at + step]]
            sums = np.zeros((len(part) + 1, len(langs)), np.int64)
            np.cumsum(part, axis=0, out=sums[1:])
            a, b = (np.clip(x - at, 0, len(part)) for x in (first, np.maximum(end, first)))
            some = np.flatnonzero(b > a)
            total[some] += sums[b[some]] - sums[a[some]]
    best = total.argmax(1)
    p = 1 / np.exp((total - total.max(1, keepdims=True)) / UNIT).sum(1)
    known = np.array([bool(t and _LETTER.search(t)) for t in texts])
    return [langs[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, p, 0.0)


def identify(docs: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """Adds lang_pred and score to ``docs`` and drops its text."""
    if not langs:
        return docs.drop("text").withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    model = docs.sparkSession.sparkContext.broadcast(logp)

    def batch(texts: list) -> dict:
        names, p = score(texts, langs, model.value)
        return {"lang_pred": names, "score": p}

    return map_texts(docs, {"lang_pred": T.StringType(), "score": T.DoubleType()}, batch)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    labelled = docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select("doc_id", "text", "lang")
    langs, logp = train(labelled)
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), langs, logp).select("doc_id", "held_out", "lang_pred", "score")
