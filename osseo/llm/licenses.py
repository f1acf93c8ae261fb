"""Operator 10, license scans: fuzzy search for short notices.

A notice may have one edit per 12 letters (6 at most), but its naming words, those that tell one license from another, must
stand exactly. Split into one piece more than it may have edits, it leaves one piece unchanged in every place that matches, so
an automaton over all pieces finds every candidate place; there the regex library's bounded-error matching verifies the words
between the naming ones and gives the span and its edits. Texts are compared as their words (lower case, joined by single
spaces), so spans are counted in words.

Defined results: null and empty texts have no words, no labels and score 0; texts of any length are searched whole; a notice
that occurs again and again is one label; repeated rows get equal results; further columns are ignored.
"""

from __future__ import annotations

import ahocorasick
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from osseo.llm.rows import map_texts, table

# The phrases that the contract names, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Short notices as words, by label; naming words in braces.
NOTICES = [
    ("mit", "released under the {mit} license"),
    ("mit", "licensed under the {mit} license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the {apache} license version {2 0}"),
    ("apache-1.1", "licensed under the {apache} license version {1 1}"),
    ("gpl", "licensed under the {gnu general public} license"),
    ("gpl", "under the terms of the {gnu general public} license as published by the free software foundation"),
    ("lgpl", "licensed under the {gnu lesser general public} license"),
    ("agpl", "licensed under the {gnu affero general public} license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "subject to the terms of the {mozilla public} license"),
    ("mpl", "released under the {mpl} license"),
    ("mpl", "licensed under the {mpl} license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("cc-by", "licensed under {cc by 4 0}"),
    ("cc-by", "licensed under a creative commons {attribution 4 0} international license"),
    ("cc-by-nc", "licensed under {cc by nc 4 0}"),
    ("cc-by-sa", "licensed under {cc by sa 4 0}"),
    ("cc-by-nd", "licensed under {cc by nd 4 0}"),
    ("cc-by-nc-sa", "licensed under {cc by nc sa 4 0}"),
    ("cc-by-nc-nd", "licensed under {cc by nc nd 4 0}"),
    ("unlicense", "free and unencumbered software released into the public domain"),
]
LETTERS_PER_EDIT = 12
MOST_EDITS = 6
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def normal(text: str) -> str:
    """The words of the text, lower-cased in A-Z and joined by single spaces."""
    return b" ".join(text.encode().lower().translate(_WORD_BYTES).split()).decode()


class Scanner:
    """Candidate places by exact pieces, then bounded-error matching."""

    def __init__(self, notices: list[tuple[str, str]]):
        self.notices = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (label, marked) in enumerate(notices):
            notice = marked.translate({ord("{"): None, ord("}"): None})
            edits = min(MOST_EDITS, len(notice) // LETTERS_PER_EDIT)
            # odd parts are naming words; each other part has the notice's edits, and all of them together no more
            parts = regex.split("[{}]", marked)
            made = "".join(rf"(?<![^ ]){p}(?![^ ])" if i % 2 else f"(?:{p}){{e<={edits}}}" if p else "" for i, p in enumerate(parts))
            self.notices.append((label, notice, edits, regex.compile(f"(?b){made}")))
            cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(notice[a:b], []).append((k, a))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()

    def spans(self, words: str) -> list[tuple[str, int, int, int]]:
        """Label, first and last character and edits of each verified place; ``words`` as normal() makes it."""
        places = sorted({(k, end + 1 - size - a) for end, (size, uses) in self.seeds.iter(words) for k, a in uses})
        found: dict[tuple[str, int, int], int] = {}
        done = (-1, 0)
        for k, at in places:
            label, notice, edits, pattern = self.notices[k]
            if done[0] == k and at + len(notice) <= done[1]:  # within a place of the same notice that is verified
                continue
            lo, hi = max(0, at - edits), min(len(words), at + len(notice) + edits)
            if hi - lo >= len(notice) - edits and (m := pattern.search(words, lo, hi)) and sum(m.fuzzy_counts) <= edits:
                found.setdefault((label, m.start(), m.end()), sum(m.fuzzy_counts))
                done = (k, m.end())
        return [(*span, e) for span, e in sorted(found.items(), key=lambda x: (x[0][1], x[0]))]


def places(words: str, phrase: str) -> list[int]:
    """Numbers of the words at which the phrase's words stand consecutively."""
    out, padded, needle = [], f" {words} ", f" {phrase} "
    at, last, n = padded.find(needle), 0, 0
    while at >= 0:
        n += padded.count(" ", last, at)
        out.append(n)
        last, at = at, padded.find(needle, at + 1)
    return out


def scan(docs: DataFrame, notices: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """Adds n_words, the places of each phrase and the fuzzy spans of each text, and drops the text."""
    notices, phrases = notices or NOTICES, phrases or PHRASES
    made: list[Scanner] = []

    def batch(texts: list) -> dict:
        if not made:
            made.append(Scanner(notices))
        out: dict = {"n_words": [], "base": [], "spans": []}
        for text in texts:
            words = normal(text) if text else ""
            out["n_words"].append(words.count(" ") + 1 if words else 0)
            out["base"].append([{"label": label, "word": w} for phrase, label in phrases.items() if phrase in words for w in places(words, phrase)])
            spans = []
            for label, a, b, edits in made[0].spans(words):
                first = words.count(" ", 0, a)
                spans.append({"label": label, "first_word": first, "last_word": first + words[a:b].strip().count(" "), "edits": edits, "score": 1 - edits / (b - a)})
            out["spans"].append(spans)
        return out

    struct = lambda **kinds: T.ArrayType(T.StructType([T.StructField(k, v) for k, v in kinds.items()]))
    base = struct(label=T.StringType(), word=T.LongType())
    spans = struct(label=T.StringType(), first_word=T.LongType(), last_word=T.LongType(), edits=T.IntegerType(), score=T.DoubleType())
    return map_texts(docs, {"n_words": T.LongType(), "base": base, "spans": spans}, batch)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat("base.label", "spans.label")).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("spans.score"), F.lit(0.0))).alias("score"),
        F.expr("array_join(transform(spans, s -> concat_ws(':', s.label, s.first_word, s.last_word, s.edits)), ',')").alias("spans"),
    )
