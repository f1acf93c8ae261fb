"""Operator 12, quality rules as a bitmask ledger.

Every whole text is measured once. Every rule is evaluated once on the measurements, and its failure sets one bit of
``failed``; ledger rows hold the bits and the measurements. A policy is a version with two masks over the bits: one failure of
a hard rule rejects a text, and so do more failures of soft rules than the policy allows. So a new policy reads the ledger, not the
texts, and ablations (what a policy would keep without a rule) are bitwise sums over the counts of bit patterns.

Defined results: null and empty texts, and texts without a word, have zeros as measurements and fail ``few_words``; texts of any
length are measured whole; repeated rows get equal results; columns of the documents that clash with measurements are left
out of the query, and ``ledger`` replaces them; an empty table gives an empty ledger and no ablation.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from osseo.llm.rows import byte_class, map_texts, mix, span_hashes, table, word_spans

WINDOW = 3
_WORD_BYTE = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
_SYMBOL_BYTE = byte_class(lambda b: chr(b) in "#*$%&|<>")
_UPPER_BYTE, _LOWER_BYTE = byte_class(lambda b: 0x41 <= b <= 0x5A), byte_class(lambda b: 0x61 <= b <= 0x7A)
_LETTER_BYTE = _UPPER_BYTE | _LOWER_BYTE | byte_class(lambda b: b >= 0x80)
_GO_ON_BYTE = byte_class(lambda b: b & 0xC0 == 0x80)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_upper", "n_lower"]


def repeated_windows(words: list[np.ndarray], window: int = WINDOW) -> np.ndarray:
    """Which words stand in a window of so many that occurs twice or more; ``words`` are two hashes of each word of one text."""
    n = len(words[0])
    covered = np.zeros(n, bool)
    if n < window:
        return covered
    keys = []
    for w in words:
        key = np.zeros(n - window + 1, np.uint64)
        for k in range(window):
            key = mix(key ^ w[k : n - window + 1 + k]) + np.uint64(k + 1)
        keys.append(key)
    order = np.lexsort(keys)
    same = np.ones(len(order) - 1, bool)
    for key in keys:
        same &= key[order][1:] == key[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    for k in range(window):
        covered[k : n - window + 1 + k] |= twice
    return covered


def measured(texts: list) -> dict[str, np.ndarray]:
    """MEASURES of each text."""
    plain = [t or "" for t in texts]
    data, starts, ends, owner = word_spans(plain, _WORD_BYTE)
    n = len(plain)
    hashes = [span_hashes(data, starts, ends, b) for b in _BASES]
    first = np.searchsorted(owner, np.arange(n + 1))
    of_byte = np.repeat(np.arange(n), [len(t.encode()) + 1 for t in plain])
    count = lambda which: np.bincount(of_byte[which], minlength=n)
    letters = np.concatenate([[0], np.cumsum(_LETTER_BYTE[data])])
    repeats, lines, again = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, t in enumerate(plain):
        repeats[k] = int(repeated_windows([h[first[k] : first[k + 1]] for h in hashes]).sum())
        own = [x for x in t.encode().split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        lines[k], again[k] = len(own), len(own) - len({*own})
    return {
        "n_words": np.diff(first), "word_chars": count(_WORD_BYTE[data] & ~_GO_ON_BYTE[data]), "n_symbols": count(_SYMBOL_BYTE[data]), "n_dup_lines": again, "n_repeat_words": repeats,
        "n_lines": lines, "n_letter_words": np.bincount(owner[letters[ends] > letters[starts]], minlength=n), "n_upper": count(_UPPER_BYTE[data]), "n_lower": count(_LOWER_BYTE[data]),
    }


#: Rules by name: each text that meets the condition over its measurements fails. A rule's place is its bit, so new ones go last.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "n_symbols * 5 > n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 12 * n_words",
    "no_letters": "100 * n_letter_words < 80 * n_words",
    "upper_case": "100 * n_upper > 40 * (n_upper + n_lower)",
}
BITS = {name: 1 << k for k, name in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BITS[name] for name in names)


@dataclass(frozen=True)
class Policy:
    """``hard`` rules reject alone, ``soft`` ones if more than ``allowed`` of them fail."""

    hard: int
    soft: int = 0
    allowed: int = 0

    def kept(self, failed: F.Column) -> F.Column:
        return (failed.bitwiseAND(F.lit(self.hard)) == 0) & (F.bit_count(failed.bitwiseAND(F.lit(self.soft))) <= self.allowed)


#: Policies by version; a version never changes once it is in use.
POLICIES = {
    "base": Policy(mask("few_words", "repeated_words")),
    "1": Policy(mask(*RULES)),
    "2": Policy(mask("few_words", "repeated_words", "many_symbols", "upper_case"), mask("repeated_lines", "short_words", "long_words", "no_letters"), 1),
}
VERSION = "2"


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the text by MEASURES and ``failed``, a bit for each rule that it fails."""
    plain = docs.drop(*(c for c in (*MEASURES, "failed") if c in docs.columns))
    rows = map_texts(plain, {m: T.LongType() for m in MEASURES}, measured, text)
    bits = [F.when(F.expr(rule), F.lit(BITS[name])).otherwise(F.lit(0)) for name, rule in RULES.items()]
    return rows.withColumn("failed", sum(bits[1:], bits[0]).cast("long"))


def judged(rows: DataFrame, version: str = VERSION) -> DataFrame:
    """Adds ``policy`` and ``kept`` to ledger rows."""
    return rows.withColumn("policy", F.lit(version)).withColumn("kept", POLICIES[version].kept(F.col("failed")))


def ablations(rows: DataFrame, by: tuple[str, ...] = (), versions: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """For each policy and rule of it, over ledger rows: n_rows, n_failed, n_kept, and n_gained, rows kept only without the rule.

    Rows are first counted by bit pattern (2 ** rules patterns at most for each value of the columns ``by``), and all else is
    bitwise sums over these counts.
    """
    counts = rows.groupBy(*by, "failed").agg(F.count("*").alias("n"))
    cases = [F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit"), *(F.lit(x).cast("long").alias(k) for k, x in vars(POLICIES[v]).items())) for v in versions for r, b in BITS.items() if b & (POLICIES[v].hard | POLICIES[v].soft)]
    each = counts.select(*by, "failed", "n", F.inline(F.array(*cases)))
    passes = lambda failed: (failed.bitwiseAND(F.col("hard")) == 0) & (F.bit_count(failed.bitwiseAND(F.col("soft"))) <= F.col("allowed"))
    whole, without = passes(F.col("failed")), passes(F.col("failed").bitwiseAND(F.bitwise_not(F.col("bit"))))
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return each.groupBy(*by, "policy", "rule").agg(F.sum("n").alias("n_rows"), total(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), total(whole).alias("n_kept"), total(without & ~whole).alias("n_gained"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    base_failed = ~POLICIES["base"].kept(F.col("failed"))
    return rows.select("doc_id", *MEASURES[:5], base_failed.alias("base_failed"), (~base_failed & F.col("kept")).alias("kept"), "failed", "policy")


def _sql() -> str:
    failed = " + ".join(f"CASE WHEN {rule} THEN {BITS[name]} ELSE 0 END" for name, rule in RULES.items())
    use, base = POLICIES[VERSION], POLICIES["base"]
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
e AS (SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT r, i, struct_pack(a := x, b := lead(x) OVER o, c := lead(x, 2) OVER o) AS g, lead(x, 2) OVER o AS z FROM e WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i FROM g WHERE z IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM c, (VALUES (0), (1), (2)) v(k) GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, len(ls) AS n_lines,
             len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter_words,
             length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower
      FROM w LEFT JOIN p USING (r)),
f AS (SELECT *, {failed} AS failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failed & {base.hard} <> 0 AS base_failed,
       failed & {base.hard | use.hard} = 0 AND bit_count(failed & {use.soft}) <= {use.allowed} AS kept, CAST(failed AS BIGINT) AS failed, '{VERSION}' AS policy
FROM f
"""


OP12_SQL = _sql()
