"""Operator 7, personal data by bootstrapped contextual extraction; DataFrame and SQL functions only.

Base entities (e-mail, ip, card, phone) are the seeds. What stands around a seed, two tokens before and the character after,
is a lexical pattern. Patterns and the identifier-like strings that they surround form a graph, which Spark scores in turns:
a pattern is as good as the mean of its instances (smoothed, in need of several seeds), an instance counts if it is a seed or
its best pattern is a confident one. Identifier-like strings (from six letters, digits, _ or -, a digit among them) under a high-confidence pattern are reported as
well, as kind ``id``, and serve as seeds of the next round.

The base patterns are written so that the regular expressions run in linear time: runs are taken whole (possessive) and only
from their start, which leaves the matches as they are.

Defined results: null and empty texts have no spans; texts of any length are searched whole; repeated rows get equal spans;
an empty table gives an empty result; further columns are ignored by the query and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from osseo.llm.rows import packed, row_key, saved, spread_join, table

KINDS = ["email", "ip", "card", "phone"]
# The base patterns; a card is matched only where its whole run of digits has 16 to 19, an e-mail's local part
# only from the start of its run or the end of the match before.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "id": r"[A-Za-z0-9_](?<![A-Za-z0-9_-][A-Za-z0-9_])(?<=[0-9]|(?=[A-Za-z_-]*+[0-9])[A-Za-z_])[A-Za-z0-9_-]{5,}+(?![A-Za-z0-9_-])",
}
# Texts without this have no match.
NEEDS = {"email": "text LIKE '%@%'", "ip": "text RLIKE '[0-9][.][0-9]'", "card": "text RLIKE '[0-9]'", "phone": "text LIKE '%+%'", "id": "text RLIKE '[0-9]'"}
LUHN = """
aggregate(sequence(0, char_length(d) - 1), 0, (a, i) -> a + CASE WHEN i % 2 = 0 THEN int(substr(d, char_length(d) - i, 1))
  ELSE int(substr('0246813579', int(substr(d, char_length(d) - i, 1)) + 1, 1)) END) % 10 = 0"""
VALID = {
    "email": "true",
    "ip": "forall(split(x.value, '[.]'), q -> char_length(trim(LEADING '0' FROM q)) <= 3 AND int(concat('0', right(q, 3))) <= 255)",
    "card": LUHN.replace("d)", "regexp_replace(x.value, '[^0-9]', ''))").replace("(d,", "(regexp_replace(x.value, '[^0-9]', ''),"),
    "phone": "char_length(regexp_replace(x.value, '[^0-9]', '')) BETWEEN 8 AND 15",
    "id": "true",
}
#: A pattern needs so many different seeds, and this smoothed share of seeds among its instances.
LEAST_SEEDS = 3
CONFIDENT = 0.8


def _spans(kind: str) -> str:
    """SQL for the valid spans of a kind, from its matches and the pieces of text between them.

    The fold keeps the position in code points; start and end, the matched value and its context come out.
    """
    # white space counts as one space; a context of more than 80 characters stands as its hash, so no context is cut
    words = f"translate(lower(substring_index(regexp_replace({kind}_p[i - 1], '[\\\\x20\\\\x09-\\\\x0D]+', ' '), ' ', -2)), '123456789', '000000000')"
    context = f"concat(CASE WHEN char_length({words}) > 80 THEN sha2({words}, 256) ELSE {words} END, '|', left({kind}_p[i], 1))"
    return f"""
    CASE WHEN size({kind}_m) > 0 THEN filter(aggregate(sequence(1, size({kind}_m)),
      named_struct('pos', 0, 'out', CAST(array() AS array<struct<kind: string, start: int, end: int, value: string, pattern: string>>)),
      (a, i) -> named_struct('pos', a.pos + char_length({kind}_p[i - 1]) + char_length({kind}_m[i - 1]), 'out', concat(a.out, array(named_struct(
        'kind', '{kind}', 'start', a.pos + char_length({kind}_p[i - 1]), 'end', a.pos + char_length({kind}_p[i - 1]) + char_length({kind}_m[i - 1]),
        'value', {kind}_m[i - 1], 'pattern', {context})))), a -> a.out), x -> {VALID[kind]})
    ELSE CAST(array() AS array<struct<kind: string, start: int, end: int, value: string, pattern: string>>) END"""


def scan(docs: DataFrame) -> DataFrame:
    """rk, doc_id, base (spans by kind and start) and ids (identifier-like strings that touch no base span) of each row."""
    rows = docs.select("doc_id", row_key().alias("rk"), F.coalesce("text", F.lit("")).alias("text"))
    found = []
    for kind, pattern in PATTERNS.items():
        has = F.expr(NEEDS[kind])
        found += [F.when(has, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.expr("CAST(array() AS array<string>)")).alias(f"{kind}_m"), F.when(has, F.split("text", pattern, -1)).otherwise(F.expr("CAST(array() AS array<string>)")).alias(f"{kind}_p")]
    matched = rows.select("doc_id", "rk", *found)
    spans = matched.select("doc_id", "rk", F.expr(f"concat({', '.join(_spans(k) for k in KINDS)})").alias("base"), F.expr(_spans("id")).alias("loose"))
    return spans.select("doc_id", "rk", "base", F.expr("filter(loose, x -> NOT exists(base, b -> b.start < x.end AND x.start < b.end))").alias("ids"))


def confident_patterns(scanned: DataFrame) -> DataFrame:
    """The patterns (one column) that the graph scores as confident.

    What a confident pattern surrounds is a seed of the next round, so patterns around discovered identifiers count as well;
    what only a doubtful one surrounds is worth nothing, so no pattern rises by its own instances. Confidence only rises, and
    the rounds end when the confident patterns stay, however far a pattern is from the seeds.
    """
    of = lambda spans, seed: scanned.select(F.explode(spans).alias("x")).select("x.pattern", "x.value", F.lit(seed).alias("seed"))
    edges = saved(of("base", 1.0).unionByName(of("ids", 0.0)).groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    worth = edges.groupBy("value").agg(F.max("seed").alias("worth"), F.count("*").alias("n"))
    before = -1
    while True:
        # the hot keys of both joins, a common pattern and a value that stands everywhere, are broadcast
        scored = spread_join(edges, saved(worth), ["value"]).groupBy("pattern").agg(
            (F.sum("worth") / (F.count("*") + 1)).alias("confidence"), F.count_if(F.col("worth") > 0).alias("seeds"), F.count("*").alias("n")
        )
        scored = saved(scored)
        good = scored.where((F.col("seeds") >= LEAST_SEEDS) & (F.col("confidence") >= CONFIDENT))
        found = good.count()
        if found == before:
            return good.select("pattern")
        before = found
        accepted = F.when((F.col("seeds") >= LEAST_SEEDS) & (F.col("confidence") >= CONFIDENT), 1.0).otherwise(F.col("seed"))
        worth = spread_join(edges, scored, ["pattern"]).groupBy("value").agg(F.max(accepted).alias("worth"), F.count("*").alias("n"))


def find(docs: DataFrame) -> DataFrame:
    """rk, doc_id, base and found (what confident patterns discover) of each row; ``docs`` has doc_id and text."""
    scanned = saved(scan(docs))
    good = confident_patterns(scanned)
    loose = scanned.select("rk", F.explode("ids").alias("x")).select("rk", "x", "x.pattern")
    counted = saved(loose.groupBy("pattern").agg(F.count("*").alias("n")).join(good, "pattern"))
    more = spread_join(loose, counted, ["pattern"]).groupBy("rk").agg(F.array_sort(F.collect_set(F.struct("x.start", "x.end"))).alias("found"))  # no more than a text has
    none = F.expr("CAST(array() AS array<struct<start: int, end: int>>)")
    return scanned.join(more, "rk", "left").select("rk", "doc_id", "base", F.coalesce("found", none).alias("found"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; n_chars follows the text if there is such a column.

    Spans that overlap are replaced together, under the kind of the first.
    """
    spans = find(docs.select("doc_id", "text")).where("size(base) + size(found) > 0").dropDuplicates(["rk"])
    listed = F.expr("array_sort(concat(transform(base, x -> struct(x.start AS s, x.end AS e, x.kind AS k)), transform(found, x -> struct(x.start AS s, x.end AS e, 'id' AS k))))")
    joined = packed(docs).join(spans.select("rk", listed.alias("spans")), "rk", "left")
    masked = F.expr("""
      aggregate(spans, named_struct('at', 0, 'out', ''), (a, x) -> named_struct('at', greatest(a.at, x.e), 'out',
        CASE WHEN x.s >= a.at THEN concat(a.out, substr(text, a.at + 1, x.s - a.at), '[', upper(x.k), ']') ELSE a.out END),
        a -> concat(a.out, substr(text, a.at + 1)))""")
    out = joined.select("row", "spans", F.when(F.col("spans").isNotNull(), masked).alias("masked"))
    new = {"text": F.col("masked"), "n_chars": F.char_length("masked")}
    old = lambda f: F.col("row").getField(f.name)
    return out.select(*(F.when(F.col("spans").isNull(), old(f)).otherwise(new[f.name].cast(f.dataType)).alias(f.name) if f.name in new else old(f).alias(f.name) for f in docs.schema.fields))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = lambda spans: F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")
    every = "concat(transform(base, x -> struct(x.kind AS kind, x.start AS start, x.end AS end)), transform(found, x -> struct('id' AS kind, x.start AS start, x.end AS end)))"
    counts = [F.expr(f"CAST(size(filter(base, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in KINDS]
    return got.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text(every).alias("spans"))
