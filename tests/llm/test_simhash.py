import random

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from symgraph.llm import simhash as S

SCHEMA = "doc_id long, text string, fp string"


def plain(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def grouped(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprint_is_the_plain_one():
    for t in (None, "", " \n", "One", "a b c", "a b c d", "É x y  z\tQ\nr " * 300, "w x y"):
        assert S.fingerprint(t) == plain(t)


def test_groups_match_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 90))) for _ in range(60)]
    for t in list(texts):
        w = t.split()
        if len(w) > 60:
            w[rng.randrange(len(w))] = "x"
            texts.append(" ".join(w))
    texts += [None, "", "  ", texts[0], texts[0].upper(), "long " * 60_000]
    rows = [(i * 7 % 1009, t, "clash") for i, t in enumerate(texts)] + [(None, texts[0], None), (None, None, None), (0, texts[0], "clash")]
    out = S.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    fps = [plain(t) for _, t, _ in rows]
    want = sorted(map(str, zip([r[0] for r in rows], [f"{f:016x}" for f in fps], grouped([r[0] for r in rows], fps), strict=True)))
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in out) == want


def test_links_join_all_near_fingerprints_though_buckets_are_dealt_again(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = set(base)
    for b in base[:6]:
        for _ in range(60):
            fps.add(b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 6))))
    fps = sorted(fps)
    df = spark.createDataFrame(pd.DataFrame({"fp": np.array(fps, np.uint64).view(np.int64)}))
    for large in (8192, 8):
        e = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in S.links(df, large=large).collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in e)
        at = {f: i for i, f in enumerate(fps)}
        root = list(range(len(fps)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in e:
            root[max(find(at[a]), find(at[b]))] = min(find(at[a]), find(at[b]))
        want = grouped(list(range(len(fps))), fps)
        got = [find(i) for i in range(len(fps))]
        assert len(set(want)) == len(set(got)) == len(set(zip(want, got, strict=True)))


def test_empty(spark):
    assert S.near_groups(spark.createDataFrame([], SCHEMA)).where(F.lit(True)).collect() == []


def jaccard(a, b, words=5):
    x, y = ({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_one_of_each_group_of_similar_texts_stays(spark):
    """All pairs well over the similarity are found, and texts well under it stay, also where buckets are dealt again."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(4000)]
    texts, near = [], set()
    for g in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(80, 400))]
        texts.append(" ".join(base))
        for _ in range(3):
            w = list(base)
            for _ in range(rng.choice([1, 1, len(w) // 100, len(w) // 12])):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    for i in range(len(texts)):
        for j in range(i):
            if i // 4 == j // 4 and jaccard(texts[i], texts[j]) >= 0.87:
                near.add(i)
    far = {i for i in range(len(texts)) if all(jaccard(texts[i], texts[j]) < 0.6 for j in range(i // 4 * 4, i))}
    extra = [(500, None, None), (501, "", None), (502, " ", None), (None, texts[0], None), (3, texts[3], "x")]
    df = spark.createDataFrame(rows + extra, SCHEMA)
    out = S.one_of_each(df)
    assert out.columns == df.columns
    kept = [r.doc_id for r in out.collect()]
    assert not near & set(kept) and far <= set(kept) and len(near) > 40 and len(far) > 45
    assert None in kept and 500 in kept and 501 not in kept and 502 not in kept
    fps = S.sketches(df.where("doc_id < 500"), 5).groupBy("f0", "f1", "f2", "f3").agg(F.min("doc_id").alias("node"), F.min("keys").alias("keys"))
    joined = [{frozenset((r.a, r.b)) for r in S.components(S.similar_links(fps, S.bits_for(0.8), large=n)).select(F.col("node").alias("a"), F.col("root").alias("b")).collect()} for n in (8192, 2)]
    assert joined[0] == joined[1]
    assert S.one_of_each(df.limit(0)).collect() == []


def test_similarity_decides_at_the_edge(spark):
    """Pairs just at and just under the similarity, by brute force; one document has a passage many times."""
    rng = random.Random(31)
    words = [f"w{i}" for i in range(9000)]
    texts = []
    for g in range(150):
        base = [rng.choice(words) for _ in range(rng.choice([9, 30, 100, 300]))]
        other = list(base)
        while jaccard(" ".join(base), " ".join(other)) >= (0.82 if g % 2 else 0.8):
            before = list(other)
            other.append(rng.choice(words))
        texts += [" ".join(base), " ".join(before if g % 3 else other)]
    text = " ".join(rng.choices(words, k=300))
    texts += [text, text + (" " + " ".join(text.split()[:20])) * 40]
    want = {i for i in range(1, len(texts), 2) if jaccard(texts[i], texts[i - 1]) >= 0.8}
    got = {r.doc_id for r in S.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id").collect()}
    assert set(range(len(texts))) - got == want and 40 < len(want) < 130 and len(texts) - 1 in want


def test_planted_copies_are_found_as_brute_force_finds_them(spark):
    """The documents kept of a whole table are those that all pairs of similarity 0.8 or more, by brute force, leave."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, set(S.shingle_set(r.text, 5).tolist())) for r in df.select("doc_id", "text").collect()]
    root, at, linked = list(range(len(rows))), {}, 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j, (_, h) in enumerate(rows):
        both = {}
        for x in h:
            for i in at.setdefault(x, []):
                both[i] = both.get(i, 0) + 1
            at[x].append(j)
        for i, n in both.items():
            if n >= 0.8 * (len(h) + len(rows[i][1]) - n):
                linked += h != rows[i][1]
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, h) in enumerate(rows):
        k = find(i) if h else None
        least[k] = min(d, least.get(k, d))
    want = {d for i, (d, h) in enumerate(rows) if least[find(i) if h else None] == d}
    assert {r.doc_id for r in S.one_of_each(df).select("doc_id").collect()} == want and len(want) < len(rows) - 20 and linked >= 10


def test_the_pivot_table_discards_pairs_of_wide_fingerprints(spark):
    """`one_of_each` goes by the pivots first; they lose no pair within the bits, and discard pairs without their own distance."""
    rng, bits = np.random.default_rng(4), S.bits_for(0.8, S.SPARE)
    base = rng.integers(0, 1 << 64, (40, S.PARTS), np.uint64)
    fp = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, base.shape, np.uint64)) for _ in range(6)])
    rows = pd.DataFrame(fp.view(np.int64), columns=[f"f{i}" for i in range(S.PARTS)]).assign(node=np.arange(len(fp)), key=7, n=100, whole=0)
    far = S.pivoted(spark.createDataFrame(rows)).toPandas()
    assert {"p0", "p1"} <= set(far.columns)
    pdf, own, table = S.ordered(far)
    a, b = np.triu_indices(len(pdf), 1)
    want = np.bitwise_count(own[a] ^ own[b]).sum(axis=1, dtype=np.int64) <= bits
    assert (S.near_bits(own, table, a, b, bits) == want).all() and want.sum() >= 40 * 15
    discarded = np.abs(table[a] - table[b]).max(axis=1) > bits
    assert discarded.any() and not (discarded & want).any()
    # the table decides before the distance: a pair whose table says far is not compared, though the bits are the same
    two = far.iloc[[0, 0]].assign(node=[0, 1], p0=[0, 0x7F])
    assert len(S.maybe_similar(two.assign(p0=0), bits, 0.8)) == 2 and len(S.maybe_similar(two, bits, 0.8)) == 0
    assert len(S.similar_within(two.assign(p0=0, h=[[1, 2], [1, 2]], n=2), bits, 0.8)) == 1 and len(S.similar_within(two.assign(h=[[1, 2], [1, 2]], n=2), bits, 0.8)) == 0
