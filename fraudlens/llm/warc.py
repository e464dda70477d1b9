"""Operator 3, WARC archives: a writer and a PySpark Python data source.

Writing uses Spark's text writer, whose line separator is the blank lines
that end a WARC record, so archives go to any file system that Spark writes
to, one file a task, compressed as gzip if asked. Of records with equal
payloads of at least ``min_bytes`` bytes the one with the largest id is
written as ``response``; the others become ``revisit`` records that name it
and hold no payload. Payloads are only shuffled when they are matched with
the table of repeated digests, a written table, so that Spark can split a
digest that very many pages share.

Reading is the data source ``warc``. It plans partitions of whole files,
small ones together and about ``partitionBytes`` each; takes over equality
and ``IN`` filters on record type and on header columns; parses a record's
headers first; and skips the payload of records that a filter refuses, or of
all if the option ``payload`` is false. It streams, holding one record.

Edge cases: a null payload is empty. Payloads may hold any bytes, also text
that looks like a record. A null id is lower than every other; if it is the
only one, all its records are responses. Repeated rows with the largest id
are all responses. A null url has no target header; line ends in a url are
percent-encoded. An empty table gives an archive without records.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
import pyarrow as pa
import uuid

from fraudlens.llm.common import write_table
from fraudlens.session import ensure_checkpoint_dir

MIN_REVISIT_BYTES = 1000
END = "\r\n\r\n"
SCHEMA = ("record_type string, record_id string, target_uri string, refers_to string, payload_digest string, "
          "payload_bytes long, content_type string, payload binary")
#: Header that fills each column; all of them can be filtered before a payload is read.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri",
           "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_type": "content-type"}
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
                   min_bytes: int = MIN_REVISIT_BYTES, compress: bool = True, date: str = "2024-01-01T00:00:00Z") -> None:
    """One record per row of ``pages``, as WARC files under ``path``."""
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    recs = pages.select(F.col(f"`{page_id}`").cast("long").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("body"))
    recs = recs.withColumns({"n": F.octet_length("body").cast("long"), "sha1": F.sha1("body")})
    same = write_table(recs.where(F.col("n") >= min_bytes).groupBy("sha1", "n").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("c"))
                       .where((F.col("c") > 1) & F.col("first").isNotNull()).drop("c"), "repeated-payloads")
    recs = recs.join(same, ["sha1", "n"], "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    safe = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.when(again, F.lit(HTTP.encode())).otherwise(F.concat(F.lit(HTTP.encode()), F.col("body")))
    head = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.coalesce(urn(F.col("id")), F.lit("<urn:page:>"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", safe), F.lit("")),
        F.when(again, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
                               line("WARC-Refers-To", urn(F.col("first"))))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("X-Payload-Length", F.col("n").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"))
    # a cast from binary keeps the bytes as they are; the writer adds the end of the record
    out = recs.select(F.concat(head.cast("binary"), block).cast("string").alias("value"))
    out.write.option("lineSep", END).option("compression", "gzip" if compress else "none").text(path)


@dataclass
class Files(InputPartition):
    paths: list[str]


def _open(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")
    return system.open_input_stream(name, compression="gzip" if name.endswith(".gz") else None, buffer_size=1 << 20)


def records(stream, want_payload, accept) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload) of the records that ``accept`` takes. The payload
    of others, and of all without ``want_payload``, is read over unparsed."""
    f = io.BufferedReader(stream, 1 << 20)
    while True:
        first = f.readline()
        while first in (b"\r\n", b"\n"):
            first = f.readline()
        if not first:
            return
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should start: {first[:40]!r}")
        headers = {}
        while (x := f.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = x.decode("utf-8", "replace").partition(":")
            headers[k.strip().lower()] = v.strip()
        left = int(headers["content-length"])
        if not accept(headers):
            take = False
        else:
            take = want_payload
        if take:
            block = f.read(left)
            if len(block) != left:
                raise EOFError("a WARC record ends before its length")
            if headers.get("content-type", "").startswith("application/http"):
                block = block.partition(b"\r\n\r\n")[2]
            yield headers, block
        else:
            while left:
                got = len(f.read(min(left, 1 << 20)))
                if not got:
                    raise EOFError("a WARC record ends before its length")
                left -= got
            if accept(headers):
                yield headers, None


class _Raw(io.RawIOBase):
    """A pyarrow input stream as a raw Python stream."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self):
        return True

    def readinto(self, b):
        data = self.stream.read(len(b))
        b[:len(data)] = data
        return len(data)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.want_payload = options.get("payload", "true").lower() != "false"
        self.bytes = int(options.get("partitionbytes", options.get("partitionBytes", 64 << 20)))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        """Take over equality and IN on header columns; give back the rest."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if isinstance(f, EqualTo) and column in HEADERS and f.value is not None:
                values = {f.value}
            elif isinstance(f, In) and column in HEADERS:
                values = {v for v in f.value if v is not None}
            else:
                yield f
                continue
            self.wanted[column] = self.wanted.get(column, values) & values

    def partitions(self):
        from pyarrow import fs

        uri = self.path if "://" in self.path else self.path.replace("file:", "file://", 1) if self.path.startswith("file:") else f"file://{self.path}"
        system, base = fs.FileSystem.from_uri(uri)
        scheme = uri[:len(uri) - len(base)]
        found = sorted((i.path, i.size) for i in system.get_file_info(fs.FileSelector(base, recursive=True))
                       if i.is_file and i.base_name[0] not in "._")
        out, size = [], self.bytes
        for p, n in found:
            if size + n > self.bytes:
                out.append([])
                size = 0
            out[-1].append(scheme + p)
            size += n
        return [Files(x) for x in out] or [Files([])]

    def _accept(self, headers: dict[str, str]) -> bool:
        return all(_value(c, headers) in v for c, v in self.wanted.items())

    def read(self, partition: Files):
        cols: list[list] = []
        held = 0
        for path in partition.paths:
            with _open(path) as stream:
                for h, payload in records(_Raw(stream), self.want_payload, self._accept):
                    cols.append([_value(c, h) for c in ("record_type", "record_id", "target_uri", "refers_to", "payload_digest")]
                                + [int(h["x-payload-length"]) if "x-payload-length" in h else None, _value("content_type", h), payload])
                    held += len(payload or b"") + 300
                    if held > 4 << 20:
                        yield _batch(cols)
                        cols, held = [], 0
        if cols:
            yield _batch(cols)


def _value(column: str, headers: dict[str, str]) -> str | None:
    v = headers.get(HEADERS[column])
    return v.removeprefix("sha1:") if v and column == "payload_digest" else v


def _batch(rows: list[list]) -> pa.RecordBatch:
    types = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)


class WarcSource(DataSource):
    """``spark.read.format("warc").option("payload", ...).load(path)``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)


def read_archives(spark: SparkSession, path: str, payload: bool = True, **options) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).options(**options).load(path)


def warc_query(pages: DataFrame) -> DataFrame:
    """Contract of ``op3``: write the archives, then read them back. Payloads
    of responses are read and measured; revisits come from their headers."""
    spark = pages.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    number = lambda c: F.regexp_extract(c, "([0-9-]+)>$", 1)
    whole = read_archives(spark, path).where(F.col("record_type") == "response").select(
        "record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        "record_type", "refers_to")
    revisits = read_archives(spark, path, payload=False).where(F.col("record_type") == "revisit").select(*whole.columns)
    return whole.unionByName(revisits).select(
        F.nullif(number("record_id"), F.lit("")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").cast("long").alias("refers_to"))


def oracle_sql(min_bytes: int = MIN_REVISIT_BYTES) -> str:
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT body, max(page_id) AS first FROM p WHERE payload_bytes >= {min_bytes} GROUP BY body),
j AS (SELECT p.*, f.first, (f.first IS NOT NULL AND p.page_id IS DISTINCT FROM f.first) AS again FROM p LEFT JOIN f USING (body))
SELECT page_id, payload_bytes, sha1(body) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to FROM j
"""
