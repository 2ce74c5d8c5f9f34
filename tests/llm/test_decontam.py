import random

import numpy as np

from symgraph.llm import decontam as D

DOCS, BENCH = "doc_id long, text string, item_id string, edits string", "item_id long, text string, doc_id string"


def least_edits(pattern, text):
    """Plain dynamic programme: least edits of the whole pattern against any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[:], i
        for j, t in enumerate(text, 1):
            row[j] = min(last[j - 1] + (p != t), last[j] + 1, row[j - 1] + 1)
    return min(row)


def norm(s):
    return " ".join("".join(c.lower() if c.isalnum() else " " for c in s).split())


def edited(s, n, rng):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[i] = rng.choice("xyzé")
        elif kind == 1:
            s.insert(i, rng.choice("xyz"))
        else:
            del s[i]
    return "".join(s)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdeilmnorst", k=rng.randint(2, 8))) for _ in range(n)).capitalize() + "."


def test_matches_brute_force():
    rng = random.Random(8)
    items = [(i, prose(rng, rng.choice([2, 3, 4, 6, 9, 14, 20]))) for i in range(12)]
    texts = []
    for _ in range(120):
        i, t = rng.choice(items)
        texts.append(prose(rng, rng.randint(0, 60)) + " " + edited(t.upper() if rng.random() < 0.3 else t, rng.randint(0, 14), rng) + "\n\n" + prose(rng, rng.randint(0, 30)))
    texts += ["", " . ", prose(rng, 3), items[3][1], items[3][1] * 3]
    p = D.passages(items)
    assert sum(len(x.codes) for x in p) == len(items)  # one passage each, so brute force is over whole items
    got = {(d, i): e for d, i, e, *_ in D.found_in(texts, p)}
    want = {}
    for d, t in enumerate(texts):
        for i, b in items:
            pattern = norm(b)
            e = least_edits(pattern, norm(t))
            if e <= int(len(pattern) * D.RATE):
                want[d, i] = e
    assert got == want and len(want) > 30


def test_spans_and_windows_and_long_texts(monkeypatch):
    rng = random.Random(9)
    long_item, short = prose(rng, 120), prose(rng, 15)
    p = D.passages([(1, long_item), (2, short)])
    part = long_item[200:420]
    text = prose(rng, 20) + " " + part + " " + prose(rng, 20)
    ((_, item, edits, a, b),) = D.found_in([text], p)
    assert item == 1 and edits == 0 and norm(text[a:b]) in norm(part)
    monkeypatch.setattr(D, "PIECE", 3000)
    big = prose(rng, 4000) + " " + short + " " + prose(rng, 50)
    ((_, item, edits, a, b),) = D.found_in([big], p)
    assert item == 2 and edits == 0 and norm(big[a:b]) == norm(short)


def test_pieces_lose_nothing_at_their_borders(monkeypatch):
    """A text cut at every offset, with the passage's words far apart."""
    rng = random.Random(12)
    item = prose(rng, 5)
    for blanks in (1, 120):
        text = (" " * blanks).join((prose(rng, 9) + " " + item + " " + prose(rng, 9)).split())
        for piece in range(40, len(text), 7 if blanks > 1 else 1):
            monkeypatch.setattr(D, "PIECE", piece)
            ((_, _, edits, a, b),) = D.found_in([text], D.passages([(1, item)]))
            assert edits == 0 and norm(text[a:b]) == norm(item)


def test_every_part_of_the_stated_length_is_found():
    rng = random.Random(13)
    item = norm(prose(rng, 90))
    p, n = D.passages([(1, item)]), D.WINDOW + D.STEP - 1
    for a in range(len(item) - n + 1):
        part = item[a : a + n].strip()
        if len(part) == n:
            assert D.found_in(["qq" + "z" * 9 + " " + part + " " + "z" * 9], p), a


def test_a_long_item_edited_within_the_rate_is_found():
    """Edits spread so that hardly a window is within the rate by itself."""
    rng = random.Random(15)
    for n in (190, 230, 300, 333, 390):
        item = (norm(prose(rng, 90)))[:n].strip()
        budget = int(len(item) * D.RATE)
        places = [round((k + 0.5) * len(item) / budget) for k in range(budget)]
        text = "".join("#" if i in places and c != " " else c for i, c in enumerate(item)).replace("#", "0")
        assert D.found_in(["zz yy " + text + " yy"], D.passages([(1, item)])), n


def test_great_ids_beside_a_null_stay_whole(spark):
    rng = random.Random(16)
    item = prose(rng, 15)
    ids = [(1 << 60) + 1, (1 << 60) + 3, None, (1 << 60) + 5]
    docs = spark.createDataFrame([(d, None if i == 3 else f"{i} {item}", None, None) for i, d in enumerate(ids)], DOCS).coalesce(1)
    bench = spark.createDataFrame([((1 << 61) + 1, item, None), (None, None, None)], BENCH).coalesce(1)
    got = D.leaks(docs, bench).collect()
    assert sorted(str((r.doc_id, r.item_id)) for r in got) == sorted(str((d, (1 << 61) + 1)) for d in ids[:3])


def test_leaks(spark, monkeypatch):
    rng = random.Random(10)
    items = [(i, prose(rng, 15), "clash") for i in range(6)] + [(None, prose(rng, 15), None), (9, None, None), (10, "ab c", None), (1, None, None)]
    rows = [(i, prose(rng, 40) + items[i % 6][1] + prose(rng, 9), None, "x") for i in range(12)]
    rows += [(50, prose(rng, 60), None, None), (51, None, None, None), (52, "", None, None), (3, rows[3][1], None, "x"), (None, rows[0][1], None, None)]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, BENCH)
    want = sorted([(i, i % 6) for i in range(12)] + [(-1, 0)])
    for most in (D.BLOCK_CHARS, 150):
        monkeypatch.setattr(D, "blocks", lambda b, most=most, f=D.__dict__["blocks"]: f(b, most))
        got = D.leaks(docs, bench).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in got) == want
        assert all(r.edits == 0 for r in got)
        monkeypatch.undo()
    assert D.leaks(docs.limit(0), bench).collect() == [] and D.leaks(docs, bench.limit(0)).collect() == []
    assert np.array_equal(D.normal("A, b")[0], np.array([97, 32, 98]))
