import random
import re

import corpus_pipeline as C
from symgraph.llm import passages as P


def plain(rows, span=P.SPAN):
    """(words removed, text) of each (doc_id, text), from the definition."""
    out, seen = {}, set()
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = re.findall(P.WORD, t or "")
        own, gone = [w.strip(" \t\r\n") for w in words], set()
        for p in range(len(own) - span + 1):
            run = tuple(own[p : p + span])
            if run in seen:
                gone.update(range(p, p + span))
            seen.add(run)
        out[i] = (len(gone), t if not gone else "".join(w for k, w in enumerate(words) if k not in gone))
    return out


def words(rng, n, vocabulary=5000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_matches_brute_force(spark):
    rng = random.Random(4)
    passages = [words(rng, n) for n in (50, 51, 52, 64, 90, 200)]
    rows = []
    for i in range(120):
        w = words(rng, rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            p, at = rng.choice(passages), rng.randint(0, len(w))
            w[at:at] = p if rng.random() < 0.7 else p[rng.randint(0, 20) :]
        rows.append((i * 13 % 127, rng.choice([" ", "  ", "\n"]).join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, rows[3][1]), (1004, "same. " * 500), (1005, "w " * 51), (1006, "v " * 52), (None, rows[4][1])]
    df = spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, f string").repartition(3)
    out = P.without_passages(df)
    assert out.columns == ["doc_id", "text", "f", "n_words_removed"]
    got = {r.doc_id: (r.n_words_removed, r.text) for r in out.collect()}
    assert got == plain(rows)
    assert sum(n > 0 for n, _ in got.values()) > 40
    assert P.without_passages(df.limit(0)).collect() == []


def test_pipeline_cuts_passages_in_the_middle_of_sentences(spark):
    """Passages of 51 to 64 words without punctuation, at every offset to the line's start, which no line finds."""
    rng, rows = random.Random(6), []
    for n in range(51, 65):
        passage = words(rng, n)
        for before in (20, 20 + 1 + n % 15):
            rows.append((len(rows), " ".join(words(rng, before) + passage + words(rng, 9)), "en", "s", 0))
    out = C.lines(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    got = {r.doc_id: len(r.text.split()) for r in out.collect()}
    for i, n in enumerate(range(51, 65)):
        assert got[2 * i] == 29 + n and got[2 * i + 1] == 30 + n % 15
