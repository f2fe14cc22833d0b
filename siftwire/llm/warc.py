"""WARC archives of web pages: write, read back, and merge the captures' index runs into one order."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwire.llm.common import stored
from siftwire.session import scratch_path

VERSION = b"WARC/1.1\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of an archive file, about; a file is read back as a whole by one task.
ARCHIVE_BYTES = 16 << 20
#: Index entries of a merge range, about.
RANGE_ROWS = 100_000
#: Bytes of an archive that are unpacked at once.
_PIECE = 1 << 14
EPOCH = 1_704_067_200  # 2024-01-01, capture time of page 0 where the table has none


def url_key(url: str) -> str:
    """Sort key of an address: host labels from the last to the first, then path and query, lower-cased."""
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", url.strip().lower())
    host = re.match(r"[^/?#]*", rest)[0]
    path = rest[len(host) :].partition("#")[0] or "/"
    return ",".join(reversed(re.sub(r"^www\d*\.", "", host).split("."))) + ")" + path


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _header_safe(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"[\x00-\x20\x7F]", "%20")


def with_revisits(pages: DataFrame, row_id: str, payload: str, min_bytes: int) -> DataFrame:
    """Pages with ``__sha1`` of the payload and ``__first``, the largest id among equal payloads where it is another's.

    Equal payloads meet as digests in an aggregate; only digests that repeat are joined back, so the
    join has two plain exchanges, which adaptive execution can split when one payload is very common.
    """
    text = F.coalesce(F.col(payload), F.lit(""))
    pages = pages.withColumns({"__sha1": F.sha1(text), "__bytes": F.octet_length(text).cast("bigint")})
    again = stored(
        pages.filter(F.col("__bytes") >= min_bytes).groupBy("__sha1")
        .agg(F.max(row_id).alias("__top"), F.count("*").alias("__n")).filter("__n > 1").drop("__n"),
        "warc-repeats",
    )
    joined = pages.join(again, "__sha1", "left")
    return joined.withColumn("__first", F.when(~F.col("__top").eqNullSafe(F.col(row_id)), F.col("__top"))).drop("__top")


def write_archives(
    pages: DataFrame, path: str, row_id: str = "page_id", url: str = "url", payload: str = "html",
    captured: Column | None = None, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """One WARC record per row into files below ``path``, in order of arrival.

    Of rows with equal payloads of at least ``min_bytes`` that with the largest id is a response, the
    others are revisits that refer to it and carry its length and digest but no payload. A null
    payload is empty, a null url an empty one, and a null id no id: such a row revisits the largest id
    that is known, and where none is, all are responses. Every record is a gzip member of its own, so the
    index's offset and length find it in the file. Spark's text writer puts the members down, which makes the files
    written, committed and retried as any output of Spark: its line end is the zero byte that a member ends with.
    """
    captured = captured if captured is not None else F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.col(row_id), F.lit(0)))
    rows = with_revisits(
        pages.select(
            F.col(row_id).cast("bigint").alias("id"), F.col(url).alias("url"),
            F.coalesce(F.col(payload), F.lit("")).alias("payload"), F.coalesce(captured, F.timestamp_seconds(F.lit(EPOCH))).alias("captured"),
        ),
        "id", "payload", min_bytes,
    )
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    revisit = F.col("__first").isNotNull()
    block = F.when(revisit, HTTP_HEAD).otherwise(F.concat(F.lit(HTTP_HEAD), "payload"))

    def line(field: str, value: Column) -> Column:
        return F.concat(F.lit(f"{field}: "), value, F.lit("\r\n"))

    record = F.concat(
        F.lit(VERSION.decode()),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), name, F.lit(">"))),
        line("WARC-Date", F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", _header_safe(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), _base32_of_hex("__sha1"))),
        line("X-Payload-Length", F.col("__bytes").cast("string")),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit(REVISIT_PROFILE)),
                line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("__first").cast("string"), F.lit(">"))),
            ),
        ).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    size = pages.agg(F.sum(F.octet_length(payload).cast("bigint"))).first()[0] or 0
    files = max(1, -(-size // archive_bytes))
    # Dealt by place, not by key: a common address or payload is spread like any other row.
    members = rows.select(record.alias("record")).repartition(files).mapInArrow(_members, "value binary")
    members.select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)


_EMPTY = gzip.compress(b"", mtime=0)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A gzip member for each record, without its last byte, the highest of the record's length, which is zero below 16 MiB.

    A longer record is followed by a member with nothing in it, which ends so, too.
    """
    for batch in batches:
        out = []
        for record in batch.column(0):
            member = gzip.compress(record.as_buffer().to_pybytes() + b"\r\n\r\n", compresslevel=6, mtime=0)
            out.append((member if member.endswith(b"\0") else member + _EMPTY)[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def _base32_of_hex(column: str) -> Column:
    """Upper-case base32 of 20 bytes in hexadecimal: every five hexadecimal digits are four of base 32."""
    five_bits = f"cast(conv(substring({column}, i div 4 * 5 + 1, 5), 16, 10) as int) >> (15 - 5 * (i % 4)) & 31"
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    return F.expr(f"array_join(transform(sequence(0, 31), i -> substring({letters}, ({five_bits}) + 1, 1)), '')")


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, block) of a record."""
    if not record.startswith(VERSION):
        raise ValueError("no WARC record")
    end = record.index(b"\r\n\r\n")
    lines = record[len(VERSION) : end].decode("utf-8").split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    first = end + 4
    last = first + int(fields["content-length"])
    if record[last:] != b"\r\n\r\n":
        raise ValueError("a record does not end where it says")
    return fields, record[first:last]


def parse_archive(data: memoryview | bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header fields, block) of every record of an archive file; offset and length are those of its member."""
    at, data = 0, memoryview(data)
    while at < len(data):
        member, place, parts = zlib.decompressobj(31), at, []
        while not member.eof:
            if place >= len(data):
                raise ValueError(f"the member at byte {at} does not end")
            piece = data[place : place + _PIECE]
            parts.append(member.decompress(piece))
            place += len(piece)
        end = place - len(member.unused_data)
        if record := b"".join(parts):
            yield at, end - at, *parse_record(record)
        at = end


def _number(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


ENTRY = (
    "run string, seq int, url_key string, url string, captured string, page_id long, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, offset long, length long"
)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archives below ``path``; each file is one run, sorted by (url key, time, id).

    Length and digest of a response are those of the bytes read; a revisit has those of its header.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for offset, length, fields, block in parse_archive(content.as_buffer()):
                    payload = block.partition(b"\r\n\r\n")[2]
                    kind = fields["warc-type"]
                    own, url = kind == "response", fields.get("warc-target-uri", "")
                    rows.append((
                        name, url_key(url), url, fields["warc-date"], _number(fields["warc-record-id"]), kind,
                        _number(fields.get("warc-refers-to")),
                        len(payload) if own else int(fields["x-payload-length"]),
                        base32(hashlib.sha1(payload).digest()) if own else fields["warc-payload-digest"][5:],
                        offset, length,
                    ))
                rows.sort(key=lambda r: (r[1], r[3], -1 if r[4] is None else r[4]))
                columns = list(zip(*[(r[0], i, *r[1:]) for i, r in enumerate(rows)], strict=True)) or [()] * len(ARROW_ENTRY)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, ARROW_ENTRY, strict=True)], schema=ARROW_ENTRY
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    return files.select("path", "content").mapInArrow(read, ENTRY)


ARROW_ENTRY = pa.schema([
    ("run", pa.string()), ("seq", pa.int32()), ("url_key", pa.string()), ("url", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("offset", pa.int64()), ("length", pa.int64()),
])


class LoserTree:
    """Merges sorted lists of keys: a tournament whose inner nodes keep the loser, so a step costs one path."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, k = runs, [0] * len(runs), len(runs)
        self.losers = [-1] * k
        for run in range(k):
            self._sift(run, building=True)

    def _before(self, a: int, b: int) -> bool:
        """Whether the head of run ``a`` comes before that of run ``b``; an empty run comes last."""
        if self.at[a] >= len(self.runs[a]):
            return False
        return self.at[b] >= len(self.runs[b]) or (self.runs[a][self.at[a]], a) < (self.runs[b][self.at[b]], b)

    def _sift(self, run: int, building: bool = False) -> None:
        node = (run + len(self.runs)) // 2
        while node:
            rival = self.losers[node]
            if building and rival < 0:
                self.losers[node] = run
                return
            if self._before(rival, run):
                self.losers[node], run = run, rival
            node //= 2
        self.losers[0] = run

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, position) of every key in order."""
        for _ in range(sum(map(len, self.runs))):
            run = self.losers[0]
            yield run, self.at[run]
            self.at[run] += 1
            self._sift(run)


def merge_runs(entries: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``entries`` of all runs in one order: ``range`` and ``place`` (from 0 in a range) say where.

    One range exchange by (url key, time, id, run, place in the run) cuts every run into slices; an
    address that was captured very often is cut by time. Each task merges the slices of its range,
    about ``range_rows`` entries, by a loser tree. ``capture`` numbers an address's captures in it.
    """
    ranges = max(1, -(-entries.count() // range_rows))
    key = [F.col("url_key"), F.col("captured"), F.coalesce("page_id", F.lit(-1)), F.col("run"), F.col("seq")]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, schema=ARROW_ENTRY)
        if not len(rows):
            return
        run = rows["run"].to_numpy()
        edges = np.concatenate(([0], np.nonzero(run[1:] != run[:-1])[0] + 1, [len(run)])).tolist()
        ids = [-1 if i is None else i for i in rows["page_id"].to_pylist()]
        keys = list(zip(rows["url_key"].to_pylist(), rows["captured"].to_pylist(), ids, strict=True))
        order = [edges[r] + i for r, i in LoserTree([keys[a:b] for a, b in zip(edges, edges[1:], strict=False)])]
        capture = []
        for n, i in enumerate(order):
            capture.append(capture[-1] + 1 if n and keys[i][0] == keys[order[n - 1]][0] else 0)
        out = rows.take(pa.array(order))
        part = pa.array([TaskContext.get().partitionId()] * len(order), pa.int32())
        for name, column in (("range", part), ("place", range(len(order))), ("capture", capture)):
            out = out.append_column(name, pa.array(column, pa.int32()))
        yield from out.to_batches()

    return (
        entries.repartitionByRange(ranges, *key)
        .sortWithinPartitions("run", "seq")
        .mapInArrow(merge, ENTRY + ", range int, place int, capture int")
    )


def histories(merged: DataFrame) -> DataFrame:
    """``merged`` with its ``position`` from 0 over all ranges, and ``capture`` numbered over all of an address.

    What the ranges before hold is one number a range. An address goes on from range to range only if it
    starts one, so only such addresses, no more than ranges, are counted by range.
    """
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = merged.groupBy("range").agg(F.count("*").alias("n"))
    offsets = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    starts = merged.filter("place = 0").select("url_key").distinct()
    parts = merged.join(starts, "url_key", "left_semi").groupBy("url_key", "range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("url_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("url_key", "range", F.sum("n").over(earlier).alias("__carried"))
    joined = merged.join(offsets, "range").join(carried, ["url_key", "range"], "left")
    return joined.withColumns({
        "position": F.col("__offset") + F.col("place"),
        "capture": F.col("capture") + F.coalesce("__carried", F.lit(0)),
    }).drop("__offset", "__carried", "range", "place")


def capture_index(pages: DataFrame, min_bytes: int = 0, range_rows: int = RANGE_ROWS, **names) -> DataFrame:
    """Archives of ``pages`` written, read back, and their index runs merged into capture histories."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes=min_bytes, **names)
    entries = stored(read_archives(pages.sparkSession, path), "warc-runs")
    return histories(stored(merge_runs(entries, range_rows), "warc-merged"))


def archive_digest(pages: DataFrame) -> DataFrame:
    return capture_index(pages).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "position", "capture"
    )
