"""WARC archives of captured pages and a globally ordered index of their captures.

Writing: every partition sorts its captures by URL key, time and id and writes them as gzip-compressed WARC files, one
locally sorted run each. Of captures with equal payloads the one with the largest id is kept whole (response), the others
refer to it (revisit). Reading: the archives are parsed record by record. Index: the entries of all runs are dealt out by
ranges of (URL key, time, id), and each range merges its k runs with a loser tree, so that the partitions of the result
are in one global order. Payloads cross the network at most once, and not at all when Spark finds the table of
repeated payloads small enough to broadcast.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatstream.llm.common import stored
from chatstream.session import shared_dir

INDEX = "run string, seq long, page_id long, url string, captured_at string, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long"
END = "\r\n"


def url_key(url: Column) -> Column:
    """Host labels reversed, then path and query, all but the path in lower case; without scheme, port, www and fragment."""
    parts = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:[wW]{3}\d*\.)?([^/?#:]*)(?::\d*)?([^#]*)"
    host = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(url, parts, 1)), r"\.")), ",")
    return F.when(url.rlike(parts), F.concat(host, F.lit(")"), F.regexp_extract(url, parts, 2))).otherwise(F.coalesce(url, F.lit("")))


def base32_sha1(payload: Column) -> Column:
    """SHA-1 as 32 upper-case base32 characters, 20 bits at a time."""
    digits, letters = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    sha = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(sha, k + 1, 5), 16, 32), 4, "0") for k in range(0, 40, 5)]
    return F.translate(F.concat(*groups), digits, letters)


def captures(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, captured_at, key, payload_bytes and payload_digest; a null html is an empty payload.

    The tables have no capture time: it is the id in seconds after the start of 2020 (null: the start itself).
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    at = F.timestamp_seconds(F.lit(1_577_836_800) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9)))
    return rows.select("*", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured_at"), url_key(F.col("url")).alias("key"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))


def _clean(c: Column) -> Column:
    """A header value: control characters percent-encoded."""
    return F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _record(kind: Column) -> Column:
    """One WARC record without the two line ends that follow it."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("payload_bytes"), F.lit(END + END))
    block = F.when(kind == "response", F.concat(http, F.col("payload"))).otherwise(http)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    return F.concat(
        F.lit(f"WARC/1.1{END}"), line("WARC-Type", kind), line("WARC-Record-ID", name(F.col("page_id"))), line("WARC-Date", F.col("captured_at")),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", _clean(F.col("url")))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(kind == "revisit", F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", name(F.col("first"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block)), F.lit(END), block)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, records_per_file: int = 20_000) -> None:
    """Write all captures as WARC files below ``folder``.

    Equal payloads of at least ``min_bytes`` are stored once. A repeated row with the largest id of its payload is a
    response like that row; a null id counts as smaller than any other.
    """
    rows = captures(pages)
    same = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    repeated = stored(same.filter((F.col("n") > 1) & F.col("first").isNotNull()).drop("n"), "payloads")
    joined = rows.join(repeated, "payload_digest", "left")
    kind = F.when(F.col("first").isNull() | F.col("first").eqNullSafe(F.col("page_id")), "response").otherwise("revisit")
    runs = joined.sortWithinPartitions("key", "captured_at", "page_id").select(_record(kind).alias("value"))
    runs.write.option("compression", "gzip").option("lineSep", END + END).option("maxRecordsPerFile", records_per_file).text(folder)


def read_archives(spark, folder: str) -> DataFrame:
    """One row per record of every archive below ``folder``: the index entries of each run, in the run's order.

    Length and digest of a response are taken from its payload; a revisit has none and repeats its headers.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "content")
    names = [f.split()[0] for f in INDEX.split(", ")]
    types = [pa.string() if f.split()[1] == "string" else pa.int64() for f in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = parse_archive(path.as_py().rpartition("/")[2], content.as_buffer())
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return files.mapInArrow(run, INDEX)


def parse_archive(run: str, content) -> list[tuple]:
    """The records of one compressed archive, payloads read by their stated length."""
    out = []
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as f:
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/1."):
                raise ValueError(f"{run}: a record begins with {line[:40]!r}")
            offset, headers = f.tell() - len(line), _headers(f)
            block = io.BytesIO(f.read(int(headers["content-length"])))
            block.readline()
            length = int(_headers(block)["content-length"])
            kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
            if kind == "response":
                payload = block.read()
                found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if (len(payload), found) != (length, digest):
                    raise ValueError(f"{run}: damaged payload of {headers['warc-record-id']}")
            ids = [headers.get(k, "<urn:page:none>").removeprefix("<urn:page:").removesuffix(">") for k in ("warc-record-id", "warc-refers-to")]
            own, first = (None if i == "none" else int(i) for i in ids)
            out.append((run, len(out), own, headers.get("warc-target-uri"), headers["warc-date"], length, digest, kind, first, offset))
    return out


def _headers(f) -> dict[str, str]:
    out = {}
    while (line := f.readline().rstrip(b"\r\n")):
        name, _, value = line.decode().partition(": ")
        out[name.lower()] = value
    return out


def merge_runs(runs: list[list[tuple]]) -> Iterator[tuple]:
    """K-way merge of sorted runs with a loser tree: each inner node keeps the loser, one path is replayed per row."""
    k = len(runs)
    if k == 0:
        return
    at = [0] * k

    def head(r: int) -> tuple:
        return (0, runs[r][at[r]], r) if at[r] < len(runs[r]) else (1, (), r)

    heads = [head(r) for r in range(k)]
    losers = [-1] * k
    winner = -1
    for r in range(k):
        node, now = (r + k) // 2, r
        while node > 0 and losers[node] >= 0:
            if heads[losers[node]] < heads[now]:
                losers[node], now = now, losers[node]
            node //= 2
        if node > 0:
            losers[node] = now
        else:
            winner = now
    while heads[winner][0] == 0:
        yield heads[winner][1]
        at[winner] += 1
        heads[winner] = head(winner)
        node, now = (winner + k) // 2, winner
        while node > 0:
            if heads[losers[node]] < heads[now]:
                losers[node], now = now, losers[node]
            node //= 2
        winner = now


def capture_histories(index: DataFrame) -> DataFrame:
    """The index entries with their URL key, in global order of (key, captured_at, page_id): partition after partition.

    Each partition is a range of the order that holds parts of all runs; even one URL with most captures falls into
    several, as the id is part of the order.
    """
    spark = index.sparkSession
    keyed = stored(index.withColumn("key", url_key(F.col("url"))), "index")
    # the id is shifted so that null comes first, as in the runs
    ranged = keyed.withColumn("place", F.coalesce("page_id", F.lit(-(2**63)))).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "captured_at", "place")

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([f.astype(object).where(f.notna(), None) for f in frames] or [pd.DataFrame(columns=ranged_columns)], ignore_index=True)
        order = [ranged_columns.index(c) for c in ("key", "captured_at", "place", "run", "seq")]
        runs: dict[str, list[tuple]] = {}
        for row in rows.itertuples(index=False, name=None):
            runs.setdefault(row[0], []).append((tuple(row[i] for i in order), row))
        if runs:
            yield pd.DataFrame([row for _, row in merge_runs(list(runs.values()))], columns=ranged_columns).drop(columns="place").astype({"page_id": "Int64", "refers_to": "Int64"})

    ranged_columns = ranged.columns
    return ranged.sortWithinPartitions("run", "seq").mapInPandas(merge, keyed.schema)


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write archives of all pages to the shared folder, read them back and return the ordered captures."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    write_archives(pages, folder, min_bytes)
    return capture_histories(read_archives(spark, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "key", "captured_at", "run", "offset")
