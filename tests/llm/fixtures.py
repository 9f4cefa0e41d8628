"""Small documents with everything that can go wrong in them."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "size long, key string, fp long, base string, spans string, score double, t string, part int, label int, terms string")


def edge_rows():
    r = random.Random(5)
    words = [f"w{r.randrange(400)}" for _ in range(30_000)]
    texts = [None, "", " \t\n", "one", "one two three", "same text here is the same text here is", "same text here is the same text here is",
             " ".join(words), "x" * 60_000, "1 2 " * 8_000, "a@b.c " * 500, "é ñ 中文 \U0001f600 ́́ ", "\x1c\x1d a b",
             "<|endoftext|> a <|startoftext|>  b<|endoftext|>", "line\nline\nline\nother\n\nline", "mail x.y@example.org or 10.0.0.1 now",
             " nbsp ", "UPPER lower UPPER lower", "1.2.3.4.5.6.7.8", "+" * 5_000 + "1" * 20]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None) for i, t in enumerate(texts)]
    rows += [(3, "one", "en", "s0"), (3, "one", "en", "s0"), (None, "no id", "en", "s1"), (None, None, None, None)]
    return [(i, t, lang, src, None if t is None else len(t), 7, "k", 1, "b", "s", 0.5, "t", 1, 1, "x") for i, t, lang, src in rows]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def docs(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), more.get("source", "s")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def bag(df):
    return sorted(map(repr, df.collect()))
