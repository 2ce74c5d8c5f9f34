import random
import re

from pyspark.sql import functions as F

from symgraph.llm import line_dedup as L

SCHEMA = "doc_id long, text string, n_lines string, g string, u string, runs string"


def plain(rows):
    """(n_lines, n_removed, text) for each (doc_id, text), from the definition."""
    lines = [re.findall(L.LINE, t or "") for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, gone = set(), [set() for _ in rows]
    for i in order:
        trimmed = [x.strip(" \t\r\n") for x in lines[i]]
        for p in range(len(trimmed) - L.RUN + 1):
            four = tuple(trimmed[p : p + L.RUN])
            if four in seen:
                gone[i].update(range(p, p + L.RUN))
            seen.add(four)
    return [(len(ls), len(g), t if not g else "".join(x for k, x in enumerate(ls) if k not in g)) for (_, t), ls, g in zip(rows, lines, gone, strict=True)]


def test_matches_brute_force(spark):
    rng = random.Random(12)
    sentences = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 20))).capitalize() + rng.choice([".", "!", "\n", ""]) for _ in range(40)]
    passages = [rng.sample(sentences, 6) for _ in range(5)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 8)):
            parts += rng.choice(passages) if rng.random() < 0.3 else rng.choices(sentences, k=2)
        rows.append((i * 13 % 151, rng.choice([" ", "  ", "\n"]).join(parts)))
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, rows[3][1]), (1004, "same. " * 500), (1005, "word " * 30_000), (None, rows[4][1])]
    df = spark.createDataFrame([(d, t, "clash", "g", "u", "r") for d, t in rows], SCHEMA).repartition(3)
    out = L.line_dedup(df)
    assert out.columns == ["doc_id", "text", "g", "u", "runs", "n_lines", "n_removed"]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in out.collect()}
    assert got == {d: x for (d, _), x in zip(rows, plain(rows), strict=True)}
    assert sum(x[1] > 0 for x in got.values()) > 30


def test_lines_make_up_the_text(spark):
    texts = ["One two. Three\nfour five! six", "a " * 40 + ".", "x" * 70_000, "No? Yes.\n\n  Tab\there \r\n end"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(F.array_join(L.lines_of(F.col("t")), "")).collect()] == texts


def test_repeated_rows_and_empty(spark):
    row = (1, "A b. C d. E f. G h. I j.", None, None, None, None)
    out = L.line_dedup(spark.createDataFrame([row, row, (2, *row[1:])], SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in out) == [(1, 0), (1, 0), (2, 5)]
    assert L.line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
