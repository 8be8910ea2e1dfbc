"""WARC archives: a writer for page tables and a splittable reader.

Writer: each partition writes one archive of gzip members, one record each, under a name made of its
partition number, and moves it into place when it is whole; a task that runs again on the same rows writes the
same bytes. Of records with equal payloads of at least ``least`` bytes, the one with the largest page_id is a
response and the others are revisits of it. Where several pages have that id, one of them is the response (the
first by url) and the others, though they bear the same id, revisit it.

Reader: tasks get byte ranges. Each scans its range for gzip magic, validates a candidate by decoding the
record header behind it, and owns the records that start inside its range, reading past its end for the
last of them. A payload can hold an archive of its own in stored blocks, so a candidate that lies inside
another member is dropped afterwards: members tile a file, so it starts before the largest end so far.

Null html is an empty payload. Pages with null page_id are written, sort below all others, and read back as
null; where all pages of a payload have none, nothing can be referred to and all are responses. Repeated rows are
records of their own. An empty table writes no archive and reads as no rows. Very long payloads are one record,
read back whole. Only page_id, url and html are read, so other columns clash with nothing.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.shared import written

MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string, start long, stop long"


def _filesystem(path: str):
    """(filesystem, path in it): plain files, or whatever pyarrow can open by URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path)) if not path.startswith("file:/") else (fs.LocalFileSystem(), "/" + path[5:].lstrip("/"))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, size: int, sha: str) -> bytes:
    """One record as a gzip member of its own. Same input, same bytes."""
    safe = "".join(c for c in (url or "") if c.isprintable() and c not in "\r\n")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {safe}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + payload + b"\r\n\r\n") + pack.flush()


def planned(pages: DataFrame, least: int = 0, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """page_id, url, payload, size, sha, kind, refers_to.

    Groups of equal payloads are found from digests and ids alone. Where the groups of two and more, counted, fit
    in ``broadcast_bytes``, pages stay where they are read; else they meet their group by digest, in joins that
    Spark can split where a digest is hot.
    """

    @F.pandas_udf("string")
    def sha(payload: pd.Series) -> pd.Series:
        return payload.map(digest)

    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("size"), sha("payload").alias("sha"))
    same = rows.where(F.col("size") >= least).groupBy("sha", "page_id").agg(F.count(F.lit(1)).alias("n"))
    groups = same.groupBy("sha").agg(F.sum("n").alias("all"), F.max("page_id").alias("first"), F.max_by("n", "page_id").alias("twins"))
    groups = written(groups.where("all > 1 AND first IS NOT NULL").select("sha", "first", "twins"), "groups")
    small = 96 * groups.count() <= broadcast_bytes
    joined = rows.join(F.broadcast(groups) if small else groups, "sha", "left")
    kept = ["page_id", "url", "payload", "size", "sha"]
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    twin = (F.col("twins") > 1) & F.col("page_id").eqNullSafe(F.col("first"))
    if groups.where("twins > 1").isEmpty():
        out = joined.select(*kept, "first", revisit.alias("again"))
    else:  # several pages of the largest id: the first by url is the response
        nth = F.row_number().over(Window.partitionBy("sha", "page_id").orderBy("url"))
        out = joined.where(~F.coalesce(twin, F.lit(False))).select(*kept, "first", revisit.alias("again")).union(joined.where(twin).select(*kept, "first", (nth > 1).alias("again")))
    if not small:  # rows come out of a shuffle in any order
        out = out.sortWithinPartitions("sha", "page_id", "url")
    return out.select(*kept, F.when(F.col("again"), "revisit").otherwise("response").alias("kind"), F.when(F.col("again"), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, out: str, least: int = 0) -> DataFrame:
    """Write under the folder ``out`` (seen by all executors and the driver); returns file and size of each archive."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, folder = _filesystem(out)
        final = f"{folder}/part-{task.partitionId():05d}.warc.gz"
        made = f"{final}.{task.taskAttemptId()}.tmp"
        size, f = 0, None
        for pdf in batches:
            for p in pdf.itertuples(index=False):
                if f is None:
                    fs.create_dir(folder, recursive=True)
                    f = fs.open_output_stream(made)
                page_id, refers = (None if pd.isna(x) else int(x) for x in (p.page_id, p.refers_to))
                got = record(page_id, p.url, b"" if p.kind == "revisit" else bytes(p.payload), p.kind, refers, int(p.size), p.sha)
                f.write(got)
                size += len(got)
        if f is not None:
            f.close()
            fs.move(made, final)
            yield pd.DataFrame({"file": [f"{out}/{os.path.basename(final)}"], "bytes": [size]})

    return written(planned(pages, least).mapInPandas(run, "file string, bytes long"), "archives")


def _member(f, start: int, chunk: int = 1 << 16) -> tuple[bytes, int] | None:
    """The member at ``start`` decoded, and its end; None if it is no whole record."""
    f.seek(start)
    z, out, at = zlib.decompressobj(31), bytearray(), start
    try:
        while not z.eof:
            got = f.read(chunk)
            if not got:
                return None
            at += len(got)
            out += z.decompress(got)
            if len(out) >= 5 and not out.startswith(b"WARC/"):
                return None
    except zlib.error:
        return None
    return bytes(out), at - len(z.unused_data)


def parse(data: bytes) -> dict | None:
    head, sep, rest = data.partition(b"\r\n\r\n")
    if not data.startswith(b"WARC/") or not sep:
        return None
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, sep, v = line.partition(b":")
        fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isdigit() or len(rest) < int(length):
        return None
    return fields | {"payload": rest[: int(length)]}


def scan(f, lo: int, hi: int, chunk: int = 1 << 20):
    """(start, stop, record) of the members that start in [lo, hi)."""
    at = lo
    while at < hi:
        f.seek(at)
        got = f.read(min(chunk, hi - at) + len(MAGIC) - 1)
        step = at + min(chunk, hi - at)
        found = got.find(MAGIC)
        while found >= 0 and at + found < step:
            member = _member(f, at + found)
            fields = parse(member[0]) if member else None
            last = found + 1
            if fields is not None:
                yield at + found, member[1], fields
                last = member[1] - at  # what a member holds is no record of the file
            found = got.find(MAGIC, last)
        at = step


def read_archives(spark: SparkSession, archives: DataFrame, split: int = 1 << 22, payloads: bool = False) -> DataFrame:
    """Records of the archives (columns file and bytes): RECORD, and payload if asked for."""
    ranges = archives.where("bytes > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("lo"), "bytes")
    ranges = ranges.select("file", "lo", F.least(F.col("lo") + split, F.col("bytes")).alias("hi"))
    # ranges are a few numbers each; their count says how many tasks read
    ranges = ranges.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file", "lo")

    def number(x: str | None) -> int | None:
        digits = (x or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits.lstrip("-").isdigit() else None

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                fs, path = _filesystem(r.file)
                rows = []
                with fs.open_input_file(path) as f:
                    for start, stop, x in scan(f, int(r.lo), int(r.hi)):
                        kind = x.get("warc-type")
                        body = x["payload"]
                        whole = kind != "revisit"
                        rows.append((
                            number(x.get("warc-record-id")), len(body) if whole else int(x.get("x-payload-length", 0)),
                            digest(body) if whole else x.get("warc-payload-digest", "").removeprefix("sha1:"),
                            kind, None if whole else number(x.get("warc-refers-to")), x.get("warc-target-uri"), r.file, start, stop, *([body] * payloads),
                        ))
                names = [c.split()[0] for c in RECORD.split(", ")] + ["payload"] * payloads
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    found = ranges.mapInPandas(run, RECORD + ", payload binary" * payloads)
    ahead = F.max("stop").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("_ahead", ahead).where("_ahead IS NULL OR start >= _ahead").drop("_ahead")
