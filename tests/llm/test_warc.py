import base64
import hashlib
import random

from symgraph.llm import warc as W

SCHEMA = "page_id long, url string, html string, n string, digest string, value string"


def test_loser_tree():
    rng = random.Random(3)
    for k in range(9):
        runs = [sorted(rng.choices(range(50), k=rng.choice([0, 1, 5, 20]))) for _ in range(k)]
        assert list(W.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_url_key():
    assert W.url_key("HTTPS://www.Example.com:443/A?b=2&a=1#top") == "com,example)/a?a=1&b=2"
    assert W.url_key("http://a.b.org:81") == "org,b,a:81)/" and W.url_key(None) == ")/" and W.url_key("http://[bad") == "http://[bad"


def corpus():
    rng = random.Random(5)
    nasty = ["\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "a\r\nb\r\n", "\r\n", "é\r日\n", "x" * 300_000, "", None, "line\n\n", "\r", "\n"]
    html = nasty + [f"<p>{i}</p>\n" for i in range(40)]
    rows = [(i * 17 % 211, rng.choice(["http://b.example/x", "https://www.a.example/y?q=2&p=1", f"http://c{i % 5}.example/{i}", None, "bad \r\n url"]), rng.choice(html)) for i in range(200)]
    rows += [(None, "http://n.example", "only null"), (None, None, None), rows[0], (900, "http://z.example", "same"), (901, "http://z.example", "same"), (900, "http://z.example", "same")]
    return [(*r, "clash", "x", None) for r in rows]


def test_archives_come_back(spark):
    rows = corpus()
    out = W.archive_pages(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    best = {}
    for p, _, h, *_ in rows:
        if p is not None:
            best[h or ""] = max(p, best.get(h or "", p))
    want = []
    for p, _, h, *_ in rows:
        b = (h or "").encode()
        to = best.get(h or "")
        want.append(str((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if p == to else "revisit", None if p == to else to)))
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in out) == sorted(want)
    keys = [(r.url_key, r.timestamp, -1 if r.page_id is None else r.page_id) for r in sorted(out, key=lambda r: (r.shard, r.line))]
    assert keys == sorted(keys)


def test_order_over_many_runs_and_shards(spark):
    rng = random.Random(8)
    rows = [(i, f"http://{rng.choice('abc')}.example/{rng.choice(['', 'é', 'Z', '~', str(i)])}", f"{i % 50}", None, None, None) for i in range(3000)]
    index = W.merged_index(W.read_archives(spark, archived(spark, rows, 7)), shard_rows=400)
    out = index.collect()
    keys = [(r.url_key.encode(), r.timestamp, r.page_id) for r in sorted(out, key=lambda r: (r.shard, r.line))]
    assert keys == sorted(keys) and len(set(keys)) == 3000 and len({r.shard for r in out}) > 4
    placed = W.with_place(index).orderBy("place").collect()
    assert [r.place for r in placed] == list(range(3000)) and [(r.url_key.encode(), r.timestamp, r.page_id) for r in placed] == keys


def archived(spark, rows, parts):
    path = W.shared_path(spark, "warc")
    W.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(parts), path)
    return path


def test_runs_are_merged_by_the_tree_and_found_as_they_come():
    rng = random.Random(4)
    runs = [sorted((rng.choice("ab"), "2", rng.choice([None, 1, 1 << 61])) for _ in range(n)) if n < 3 else None for n in (0, 1, 2)]
    rows = [r for run in runs for r in run] + sorted([("é", "2", 7), ("z", "2", 7), ("a", "1", 3)], key=lambda r: (r[0].encode(), r[1:]))
    batch = W._batch([(p, "u", u, t, 0, "d", "response", None) for u, t, p in rows])
    whole, cuts = W.sorted_runs(iter([batch.slice(0, 2), batch.slice(2)]))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(rows) and all(a[1] == b[0] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    for a, b in cuts:
        keys = list(W.keys_of(whole, a, b))
        assert keys == sorted(keys)


def test_great_ids_beside_a_null_stay_whole(spark):
    ids = [(1 << 60) + 1, (1 << 60) + 3, None, (1 << 60) + 5, (1 << 60) + 7]
    rows = [(p, "http://a.example", t, None, None, None) for p, t in zip(ids, ["same", "same", "same", "own", None], strict=True)]
    out = W.archive_pages(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    assert sorted(str((r.page_id, r.refers_to)) for r in out) == sorted(str(x) for x in [(ids[0], ids[1]), (ids[1], None), (None, ids[1]), (ids[3], None), (ids[4], None)])


def test_least_bytes_and_empty(spark):
    rows = [(i, "http://a.example", t, None, None, None) for i, t in enumerate(["ab", "ab", "abcd", "abcd"])]
    out = W.archive_pages(spark.createDataFrame(rows, SCHEMA), least_bytes=3).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in out) == [(0, "response", None), (1, "response", None), (2, "revisit", 3), (3, "response", None)]
    assert W.archive_pages(spark.createDataFrame([], SCHEMA)).collect() == []
