import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score int, rk string, row int, ids int, spans int, fp int, ones int, dims int"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeghilmnorstu") for _ in range(r.randint(1, 8))) for _ in range(n))


def odd_texts() -> list[tuple]:
    """Rows with nulls, empty and very long texts, repeated rows, a null id, overlapping repeats and near copies."""
    passage, item = prose(1, 80), prose(2, 30)
    texts = {
        1: None, 2: "", 3: "  \n\t ", 4: prose(3, 120), 5: prose(3, 120), 6: f"{prose(4, 20)} {passage} {prose(5, 20)}", 7: f"{passage} {prose(6, 60)}", 8: f"{prose(7, 30)}\n{item}\n{prose(8, 30)}",
        9: item.upper(), 10: "x " * 30_000, 11: "b" * 200_000, 12: prose(9, 30_000), 13: "1.2.3.4.5 0255.1.1.1 256.1.1.1 4111 1111-1111 1111 +1 (234) 555-1234 a@b.c_d@e.f a@b@c.d x@y +12 3 1234 5678 9012 3456 7890 12",
        14: "Released under the MIT License. mit license mit license", 15: "Licensed undr the Apach License, Version 2.0 é", 16: "idiot moron", 17: "<|endoftext|>hello <|endoftext|>", 18: "日本語 テキスト", 19: "!!! ### $$$ 123",
        20: "It It It It It " * 40, 21: "one", 22: prose(3, 119) + " changed", 23: " ".join(prose(3, 120).split()[:60] + prose(10, 60).split()), 24: "  \x1c\x85 é " * 5,
        25: "b" * 60_000 + " end", 26: "Licensed undr the Apache Licens, Version 2.0", 27: "word é " * 3_000, 28: f"{'x y ' * 2_000}\n{'x y ' * 2_000}\n", 29: "contact me: " + "a1" * 50,
    }
    rows = [(i, t, ["en", "de", None][i % 3], [f"s{i % 4}", None][i % 5 == 0], len(t) if t else None) for i, t in texts.items()]
    return [(*r, 1, "x", 2, 3, 4, 5, 6, 7) for r in [*rows, rows[3], rows[5], (None, "no id " + prose(11, 60), None, None, None), (None, None, None, None, None)]]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A data folder with odd rows in every table."""
    out = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(odd_texts(), DOCS).write.parquet(f"{out}/documents.parquet")
    labels = [(i, i % 2, int(i in (16, 7)), "x") for i in range(4, 24)] + [(None, None, None, None), (4, None, None, None), (999, 1, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{out}/labels.parquet")
    items = [(1, prose(2, 30), 1), (2, None, 2), (3, "", 3), (4, "日本語 テキスト", 4), (None, "abc", 5), (5, prose(2, 30), 6)]
    spark.createDataFrame(items, "item_id long, text string, rk int").write.parquet(f"{out}/benchmark.parquet")
    nan, inf = float("nan"), float("inf")
    vectors = [(i, [((i * 7 + k * 3) % 11 - 5) / 10 for k in range(8)], 0) for i in range(120)]
    vectors += [(200, None, 0), (250, [None] * 8, 0), (300, [nan] * 8, 0), (350, [inf] * 8, 0), (400, [], 0), (450, [0.0] * 8, 0), (500, [0.1, 0.2], 0), (501, [0.3, 0.2], 0), (None, [0.1] * 8, 0), vectors[0], vectors[7]]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, score int").write.parquet(f"{out}/embeddings.parquet")
    return out


@pytest.fixture(scope="session")
def empty(spark, odd, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "embeddings"):
        spark.read.parquet(f"{odd}/{name}.parquet").where(F.lit(False)).write.parquet(f"{out}/{name}.parquet")
    return out
