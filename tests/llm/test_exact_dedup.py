import hashlib
import random

import pytest
from pyspark.sql import functions as F

from symgraph.llm import exact_dedup as E

SCHEMA = "doc_id long, text string, key string, keep string, size long, recipe string, chunks string"


def plain(rows):
    """keep_id, group_size, kept and hash of each row, from the definition."""
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for d, t, *_ in rows:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        out.append(str((d, keep, len(own), d == keep, hashlib.sha256((t or "").encode()).hexdigest())))
    return sorted(out)


def corpus():
    rng = random.Random(17)
    words = lambda n: " ".join("".join(rng.choices("abcé.", k=5)) for _ in range(n))
    texts = ["", None, "a", "same words", "x" * 5000, "long. " * 40_000] + [words(rng.choice([3, 90, 500, 2000])) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i % 9]) for i in range(40)] + [rows[4], rows[4], (None, "same words"), (None, "only null"), (None, None), ((1 << 60) + 1, "big"), ((1 << 60) + 3, "big")]
    long = texts[-1] if len(texts[-1] or "") > 2000 else "chunk. " * 900
    rows += [(300, long), (301, long[:-1] + "Z"), (302, "Z" + long[1:]), (303, long)]
    return [(*r, "clash", "x", 9, None, "y") for r in rows]


@pytest.mark.parametrize("identify", [F.xxhash64, lambda c: F.length(c).cast("long"), lambda c: F.lit(7).cast("long") + F.length(c) * 0])
def test_matches_plain(spark, identify):
    """Also with identifiers that many different chunks share, where only the digests can tell texts apart."""
    rows = corpus()
    got = E.exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(4), identify=identify).collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in got) == plain(rows)


def test_chunks_make_up_the_text(spark):
    rows = corpus()
    for r in spark.createDataFrame(rows, SCHEMA).select("text", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(E.chunk_pattern()), F.lit(0)).alias("c")).collect():
        assert "".join(r.c) == (r.text or "") and all(len(c) <= E.GREATEST for c in r.c)


def test_empty(spark):
    assert E.exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
