import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from symgraph.llm import packing as P
from symgraph.llm.tokens import encoder
from tests.oracle import DIR

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, source string, row string, n string"
TRICKY = [
    "", " ", "\n", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \nb", "a\n b", "x\tb c", "don't we'll 's", "é è ü ß", "日本 語 です", "a b c​d",
    "<|endoftext|> x", "a <|endoftext|> b", "日 <|endoftext|><|endoftext|>é b<|endoftext|", "1 2 33 444", "...!! ?? --", "\0 a\0b", "a\r\nb c", "  a b", "tail \n", "🙂 🙂b", "x" * 5000, "a b\x1cc d\x85e f", "naïve cóte İ",
]


def truth():
    t = Tokenizer.from_file(PATH)
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizer():
    enc, want, rng = encoder(PATH), truth(), random.Random(4)
    texts = TRICKY + ["".join(rng.choices([*" \n\t'.,", *"abcé", "the", "ß", "1", "日", " ", " in", "'s"], k=rng.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(rng.choices(["a", " ", "b c", "é", "日", "<|endoftext|>", "<|endof", "text|>", "\n"], k=rng.randint(1, 30))) for _ in range(300)]
    for s in texts:
        assert np.frombuffer(enc.encode(s), enc.dtype).tolist() == want(s), repr(s)


def corpus(n=300):
    rng = random.Random(6)
    words = ["the", "of", "blend", "ünd", "rarely", "x1"]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 3, 50, 400, 3000]))) for _ in range(n)]
    rows = [(i, t, rng.choice(["a", "a", "b", "c", None]), "clash", None) for i, t in enumerate(texts)]
    return rows + [(None, None, None, None, None), (5, texts[5], "a", "x", "y"), (5, texts[5], "a", "x", "y"), (7, "other", "a", None, None)]


@pytest.fixture(scope="module")
def packed(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return rows, P.pack(df, PATH).collect()


def test_each_id_is_in_one_piece(packed):
    rows, out = packed
    ids = defaultdict(list)
    for d, t, *_ in rows:
        ids[d].append(np.array(truth()(t or "") + [1], "<u4"))
    pieces = defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        assert any(r.doc_tokens == len(x) and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    for d, want in ids.items():
        assert sum(r.length for r in pieces[d]) == sum(map(len, want))
        if len(want) == 1:
            at = 0
            for r in sorted(pieces[d], key=lambda r: r.start):
                assert r.start == at and r.length > 0
                at += r.length
            assert at == len(want[0])


def test_sequences_are_full_and_gapless(packed):
    _, out = packed
    seqs = defaultdict(list)
    for r in out:
        seqs[r.sequence_id].append((r.offset, r.length))
    assert sorted(seqs) == list(range(len(seqs)))
    for s, parts in seqs.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == P.WINDOW or s == max(seqs)


def test_windows_hold_the_target_shares(spark):
    """Any run of windows has each source's share of tokens, but for a packet carried at either end."""
    rows = [(i, "the blend of " * (20 + i % 90), "abc"[(i * i) % 7 % 3], None, None) for i in range(600)]
    source = {i: s for i, _, s, *_ in rows}
    out = P.pack(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    total, by = sum(r.length for r in out), defaultdict(int)
    for r in out:
        by[source[r.doc_id]] += r.length
    got = defaultdict(lambda: defaultdict(int))
    for r in out:
        got[r.sequence_id][source[r.doc_id]] += r.length
    run = dict.fromkeys(by, 0)
    for s in sorted(got)[:-1]:
        for k in by:
            run[k] += got[s][k]
            assert abs(run[k] - (s + 1) * P.WINDOW * by[k] / total) <= 3 * P.PACKET


def test_sequences_hold_the_ids(spark):
    df = spark.createDataFrame(corpus(40), SCHEMA)
    seqs = P.sequences(df, PATH, window=256, packet=64).collect()
    want = sorted(i for _, t, *_ in corpus(40) for i in truth()(t or "") + [1])
    assert sorted(i for r in seqs for i in r.input_ids) == want
    assert all(r.n_tokens == 256 for r in seqs if r.sequence_id < len(seqs) - 1)


def test_whole_documents_have_the_ids_of_the_tokenizer(spark):
    enc, want = encoder(PATH), truth()
    for r in spark.read.parquet(f"{DIR}/documents.parquet").select("text").collect():
        assert np.frombuffer(enc.encode(r.text or ""), enc.dtype).tolist() == want(r.text or "")


def test_great_ids_beside_a_null_stay_whole(spark):
    big = [(1 << 60) + 1, (1 << 60) + 3, None, -(1 << 62) - 1]
    rows = [(d, f"text {i} <|endoftext|>", None, None, None) for i, d in enumerate(big)]
    out = P.pack(spark.createDataFrame(rows, SCHEMA).coalesce(1), PATH).collect()
    got = defaultdict(int)
    for r in out:
        got[r.doc_id] += r.length
    assert got == {d: len(truth()(t)) + 1 for d, t, *_ in rows}


def test_weights_of_zero_come_last(spark):
    rows = [(i, "the blend of " * 40, "ab"[i % 2], None, None) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = P.pack(df, PATH, window=256, packet=64, weights={"a": 0.0, "b": 2.0}).collect()
    place = lambda r: r.sequence_id * 256 + r.offset
    assert max(place(r) for r in out if r.doc_id % 2) < min(place(r) for r in out if r.doc_id % 2 == 0)
    assert sum(r.length for r in out) == sum(r.length for r in P.pack(df, PATH, weights={"a": 0, "b": 0}).collect())
    with pytest.raises(ValueError):
        P.pack(df, PATH, weights={"a": -1.0})


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []
