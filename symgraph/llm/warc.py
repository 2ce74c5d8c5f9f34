"""WARC archives of pages, and their capture index by external merge.

`write_archives` makes a response or revisit record of every page and writes gzip archives with Spark's own
writer, so any file system that Spark reaches will do; `read_archives` streams them back by the records'
lengths. `merged_index` sorts the captures of each partition into a run, deals the runs out by ranges of
(URL key, timestamp, page), and merges the pieces of each range with a loser tree: the shards, one after
another, are all captures in order, each URL's history together, and `with_place` numbers them.

A page with a payload that another page of greater page_id has too is a revisit of the one with the greatest.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import islice
from typing import Any
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import maybe_in, shared_path, text_or_empty, written

#: The alphabet of base32, and the profile named by revisit records.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL, BASE_DATE, SHARD_ROWS = "\r\n", "2024-01-01 00:00:00", 500_000


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text: four letters for each twenty bits."""
    digest, letters = F.sha1(payload), []
    for i in range(8):
        v = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(v, n).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for n in (15, 10, 5, 0)]
    return F.concat(*letters)


def url_key(url: str | None) -> str:
    """The host's labels in reverse, then path and sorted query, in lower case: `com,example)/a?b=c`."""
    try:
        u = urlsplit((url or "").strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return (url or "").strip().lower()
    host = ",".join(reversed(host.removeprefix("www.").split(".")))
    at = f":{port}" if port and (u.scheme.lower(), port) not in (("http", 80), ("https", 443)) else ""
    query = "?" + "&".join(sorted(u.query.split("&"))) if u.query else ""
    return f"{host}{at}){u.path or '/'}{query}".lower()


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): its WARC record as `value`.

    Payloads are compared by SHA-256 and length. A revisit is made without its payload, and of the payloads that others
    repeat only the response's goes through a join; a bitmap of bounded size tells the rest apart.
    """
    text = pages.select("page_id", F.col("url").cast("string").alias("url"), text_or_empty("html").alias("payload"))
    rows = text.withColumn("n", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload"))).withColumn("sha", F.unhex(F.sha2("payload", 256)))
    small = written(rows.drop("payload"), "payloads")
    groups = small.where(F.col("n") >= least_bytes).groupBy("sha", "n").agg(F.max("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    groups = written(groups, "groups")
    key = F.xxhash64("sha", "n")
    told = maybe_in(small, groups.select(F.xxhash64("sha", "n").alias("k")), key, "maybe").where("maybe").drop("maybe").join(groups.hint("merge"), ["sha", "n"], "left")
    told = written(told.withColumn("to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first"), "told")
    again = told.where("to is not null").select("page_id", "url", F.lit(None).cast("string").alias("payload"), "n", "digest", "to")
    ends = told.where("to is null").select("page_id", "sha").distinct()
    none = F.lit(None).cast(text.schema["page_id"].dataType).alias("to")
    own = lambda df: df.select("page_id", "url", "payload", "n", "digest", none)
    marked = maybe_in(rows, groups.select(F.xxhash64("sha", "n").alias("k")), key, "maybe")
    some = maybe_in(marked.where("maybe"), ends.select(F.xxhash64("page_id", "sha").alias("k")), F.xxhash64("page_id", "sha"), "end").where("end")
    ends = ends.select(F.col("page_id").alias("end_id"), F.col("sha").alias("end_sha")).hint("merge")
    some = some.join(ends, (F.col("sha") == F.col("end_sha")) & F.col("page_id").eqNullSafe(F.col("end_id")), "left_semi")
    return rendered(own(marked.where(~F.col("maybe"))).unionByName(own(some)).unionByName(again))


def rendered(rows: DataFrame) -> DataFrame:
    """The records of `rows` (page_id, url, payload, n, digest, to: the page that a revisit refers to)."""
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    again = F.col("to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("n").cast("string"), F.lit(EOL + EOL))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("payload")))
    head = [
        F.concat(F.lit(f"WARC/1.1{EOL}WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), name("page_id")),
        F.concat(F.lit("WARC-Date: "), captured(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7f]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(again, F.concat(F.lit(f"WARC-Profile: {PROFILE}{EOL}WARC-Refers-To: "), name("to"))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(http).cast("long") + F.when(again, F.lit(0)).otherwise(F.col("n"))),
    ]
    return rows.select(F.concat(F.concat_ws(EOL, *head), F.lit(EOL + EOL), block).alias("value"))


def captured(page: Column) -> Column:
    """The time of a page's capture, `2024-01-01T00:00:05Z`: its number in seconds from a base date, whatever the session's time zone."""
    seconds = F.coalesce(F.pmod(page, F.lit(1 << 31)), F.lit(0))
    return F.concat(F.replace((F.to_timestamp_ntz(F.lit(BASE_DATE)) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)).cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """gzip WARC files in the folder `path`, one a partition, each record followed by two line ends."""
    records(pages, least_bytes).write.option("lineSep", EOL + EOL).option("compression", "gzip").text(path)


def parsed(lines: Iterator[str]) -> Iterator[dict[str, Any]]:
    """Records from the lines of archives; a block is as many bytes as its record says, whatever is in it."""
    for line in lines:
        if not line:
            continue
        if not line.startswith("WARC/"):
            raise ValueError(f"a record begins with {line[:60]!r}")
        fields: dict[str, Any] = {}
        for line in lines:
            if not line:
                break
            k, _, v = line.partition(":")
            fields[k.lower()] = v.strip()
        want, parts = int(fields["content-length"]), []
        left = want + len(EOL)
        while left > 0:
            part = next(lines).encode("utf-8")
            parts.append(part)
            left -= len(part) + len(EOL)
        if left:
            raise ValueError(f"a block of {want} bytes does not end at a line end")
        fields["block"] = EOL.encode().join(parts)
        yield fields


def capture(fields: dict[str, Any]) -> tuple:
    """What the index holds of a record; the digest of a full payload is computed anew and compared."""
    head, _, payload = fields["block"].partition(b"\r\n\r\n")
    told = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    n = int(re.search(rb"Content-Length: (\d+)", head)[1])
    if kind == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != told):
        raise ValueError(f"the payload of {fields['warc-record-id']} does not match its digest")
    number = lambda s: int(x) if (x := s.removeprefix("<urn:x-page:").removesuffix(">")) else None
    url = fields.get("warc-target-uri")
    stamp = re.sub(r"[^0-9]", "", fields["warc-date"])
    refers = number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
    return number(fields["warc-record-id"]), url, url_key(url), stamp, n, told, kind, refers


CAPTURE = "page_id long, url string, url_key string, timestamp string, payload_bytes long, payload_digest string, record_type string, refers_to long"
FIELDS = pa.schema([(n, {"long": pa.int64(), "string": pa.string()}[t]) for n, t in (c.split() for c in CAPTURE.split(", "))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FIELDS, strict=True)], schema=FIELDS)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives in `path`, see `CAPTURE`. gzip files are not split, so lines stay in order."""

    # Arrow, not pandas: numbers beside a null would lose digits there
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for fields in parsed(line for b in batches for line in b.column(0).to_pylist()):
            rows.append(capture(fields))
            if len(rows) == 5000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return spark.read.option("lineSep", EOL).text(path).mapInArrow(run, CAPTURE)


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so one walk to the root finds the next."""

    def __init__(self, runs: list[Iterator]) -> None:
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _wins(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, i: int) -> None:
        at = (i + self.k) // 2
        while at > 0:
            j = self.tree[at]
            if j == -1:
                self.tree[at] = i
                return
            if self._wins(j, i):
                self.tree[at], i = i, j
            at //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator:
        while self.k and (best := self.heads[self.tree[0]]) is not None:
            i = self.tree[0]
            yield best
            self.heads[i] = next(self.runs[i], None)
            at = (i + self.k) // 2
            while at > 0:
                if self._wins(self.tree[at], i):
                    self.tree[at], i = i, self.tree[at]
                at //= 2
            self.tree[0] = i


def sorted_runs(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, list[tuple[int, int]]]:
    """All rows of a task, and where its runs, stretches that are in order as they come, begin and end."""
    whole = pa.Table.from_batches([b for b in batches if b.num_rows] or [], schema=FIELDS)
    cuts = [0]
    last = None
    for at, key in enumerate(keys_of(whole, 0, whole.num_rows)):
        if last is not None and key < last:
            cuts.append(at)
        last = key
    cuts.append(whole.num_rows)
    return whole, [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def keys_of(whole: pa.Table, begin: int, end: int, step: int = 1024) -> Iterator[tuple]:
    """The keys of the rows from `begin` to `end`, with a missing page before all others; a few at a time."""
    for a in range(begin, end, step):
        part = whole.slice(a, min(step, end - a))
        for u, t, p in zip(part["url_key"].to_pylist(), part["timestamp"].to_pylist(), part["page_id"].to_pylist(), strict=True):
            yield u.encode(), t, p is not None, p or 0


def merged_index(captures: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """`captures` with `shard` and `line`: in that order they are sorted by URL key, timestamp and page_id.

    Each partition is sorted into a run and stored. Ranges of the order, of about `shard_rows` rows, are dealt to tasks, which
    get each run's piece as it was sorted; nothing sorts them again. A task finds where the pieces
    begin, and a loser tree merges them; rows stay in Arrow, and only the heads of runs are unpacked. The range goes by timestamp
    and page too, so the captures of one URL may span shards. Null page_ids come first among equals; keys are compared as bytes.
    """
    spark = captures.sparkSession
    order = [F.col("url_key"), F.col("timestamp"), F.col("page_id").asc_nulls_first()]
    runs = written(captures.sortWithinPartitions(*order), "runs")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // shard_rows))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, cuts = sorted_runs(batches)
        if not cuts:
            return
        context = TaskContext.get()
        shard = context.partitionId() if context else 0
        each = [((*key, at) for at, key in enumerate(keys_of(whole, a, b), a)) for a, b in cuts]
        tree, line = iter(LoserTree(each)), 0
        while some := [key[-1] for key in islice(tree, 10_000)]:
            out = whole.take(some)
            out = out.append_column("shard", pa.array([shard] * len(some), pa.int32())).append_column("line", pa.array(range(line, line + len(some)), pa.int64()))
            line += len(some)
            yield from out.combine_chunks().to_batches()

    return runs.repartitionByRange(shards, *order).mapInArrow(merge, f"{CAPTURE}, shard int, line long")


def with_place(index: DataFrame) -> DataFrame:
    """`index` with `place`, the number of each capture in the whole order from 0, in place of shard and line."""
    stored = written(index, "index")
    # one row a shard in this window
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = stored.groupBy("shard").agg(F.count("*").alias("n")).select("shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    return stored.join(F.broadcast(before), "shard").withColumn("place", F.col("before") + F.col("line")).drop("shard", "line", "before")


def archive_pages(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write `pages` (page_id, url, html) as archives, read them back, and give the merged index, one row per row.

    Null html is an empty payload; a null url has no target and the key `)/`. The capture time of a page, which
    the table lacks, is its page_id in seconds from a base date. Rows that repeat page_id and html are records
    of their own, all of the same type. A null page_id is a response only if its payload has no page with one.
    An empty table gives no rows; other columns are ignored. `path` must be new; by default a shared folder.
    """
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write_archives(pages, path, least_bytes)
    return merged_index(read_archives(spark, path))


#: DuckDB: the rows of the query. URL keys by pattern: scheme, host, port, path and query of plain addresses.
ORACLE = r"""
    WITH p AS (
        SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h, regexp_extract(url, '^(https?)://([^/?#:]*)(?::([0-9]+))?([^?#]*)(?:[?]([^#]*))?', ['scheme', 'host', 'port', 'path', 'query']) AS u FROM pages
    ), d AS (
        SELECT page_id, payload, strlen(payload)::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   (((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
               max(page_id) OVER (PARTITION BY payload) AS best,
               lower(array_to_string(list_reverse(string_split(regexp_replace(lower(u.host), '^www[.]', ''), '.')), ',')
                   || CASE WHEN u.port <> '' AND (u.scheme, u.port) NOT IN (('http', '80'), ('https', '443')) THEN ':' || u.port ELSE '' END || ')'
                   || CASE WHEN u.path = '' THEN '/' ELSE u.path END || CASE WHEN u.query <> '' THEN '?' || array_to_string(list_sort(string_split(u.query, '&')), '&') ELSE '' END) AS url_key
        FROM p
    )
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM best THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id IS DISTINCT FROM best THEN best END AS refers_to, url_key,
           row_number() OVER (ORDER BY url_key, page_id % 2147483648, page_id) - 1 AS place
    FROM d
"""
