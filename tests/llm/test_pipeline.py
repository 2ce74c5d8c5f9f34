import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as C
from tests.llm.test_decontam import prose
from tests.llm.test_line_dedup import plain as without_lines


def test_stages_match_a_plain_version(spark, tmp_path):
    rng = random.Random(21)
    items = [prose(rng, 25) for _ in range(4)]
    texts = []
    for i in range(90):
        t = "\n".join(prose(rng, rng.randint(5, 30)) for _ in range(rng.randint(1, 6)))
        if i % 9 == 0:
            t += "\n" + items[i % 4] + "\n" + prose(rng, 8)
        texts.append(t)
    shared = "\n".join(prose(rng, 12) for _ in range(5))
    texts += [shared + "\n" + texts[1], texts[2] + "\n" + shared, texts[3], "1234 !!", "", None]
    base = prose(rng, 400).replace(".", "")
    texts += [base, base.replace(base.split()[200], "changed", 1)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    plain = [(d, t) for d, t, *_ in rows if t and any(c.isalpha() for c in t)]
    cut = without_lines(plain)
    plain = [(d, t) for (d, _), (_, n, t) in zip(plain, cut, strict=True) if t or not n]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for _, t in plain for w in [t.lower().split()]]
    plain = [(d, t) for i, (d, t) in enumerate(plain) if not any(len(sets[i] & s) >= 0.8 * len(sets[i] | s) for s in sets[:i])]
    plain = [(d, t) for d, t in plain if not any(x in t for x in items)]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: len(tok.encode(t, add_special_tokens=False).ids) + 1 for d, t in plain}
    assert 60 < len(want) < len(texts) - 10

    docs, got = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    for i, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < len(C.STAGES) - 1:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
        else:
            got = out.collect()
    for rows in (got, C.run(spark, str(tmp_path)).collect()):
        sizes = {}
        for r in rows:
            sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
        assert sizes == want


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []
