"""WARC archives: written by Spark, indexed first, read back by coalesced byte ranges.

``write`` gives every page a WARC/1.1 record.  Of equal payloads the page with the
largest id is the response and the others are revisit records that refer to it; payloads
under ``smallest`` bytes are all responses.  Spark's text writer lays the records out,
one archive file per task (or several, of ``per_file`` records at most), with the blank
lines between records as its line separator; so archives go to any store that Spark
writes.

``index`` streams each archive once and writes one row per record: file, offset, length,
url, digest, payload length.  ``read`` sorts the selected index rows by file and offset,
joins ranges that lie within ``GAP`` bytes of one another into reads of at most ``CHUNK``
bytes, and parses the records they hold.

Defined cases: a null html is an empty payload; a null url an empty target; a null id is
smaller than any other; rows that share the largest id of a payload are all responses;
of urls, per cent signs, spaces and control characters are escaped, each as its own byte, and come back as they were; an empty table gives empty archives
and results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import delete, maybe_present, new_path, presence, scratch, stored

GAP, CHUNK, PER_FILE = 1 << 16, 1 << 23, 20_000
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = "file string, offset long, length long, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_at long, payload_bytes long"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: four letters for every 20 bits."""
    digest = F.sha1(data)
    letters = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*letters)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _records(rows: DataFrame, revisit: bool) -> DataFrame:
    """(record) of rows (id, url, digest and html or last), without the blank lines after a record."""
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    target = plain = F.replace(F.replace(F.col("url"), F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20"))
    for c in (*range(32), 127):
        target = F.replace(target, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    target = F.when(F.col("url").rlike(r"[\x00-\x1F\x7F]"), target).otherwise(plain)  # few urls have any of these
    page = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    body = F.lit("") if revisit else F.concat(F.lit(HTTP), F.col("html"))
    refers = [line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", page("last"))] if revisit else []
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.lit("revisit" if revisit else "response")),
        line("WARC-Record-ID", page("id")),
        line("WARC-Date", F.lit("2020-01-01T00:00:00Z")),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        *refers,
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, body).alias("record"))


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", smallest: int = 0) -> DataFrame:
    """(record): the text of each page's record, without the blank lines after it.

    Payloads stay where they are: the digests alone say which repeat, and only the
    responses of repeated payloads are joined with their html.
    """
    base = pages.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    base = base.withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    light = stored(base.select("id", "url", "digest", F.octet_length("html").alias("bytes")), "warc-digests")
    last = light.filter(F.col("bytes") >= smallest).groupBy("digest").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("digest", "last")
    last = stored(last, "warc-repeated")  # a table of its own: a hot digest's side of the joins can be split
    seem = maybe_present(light, "digest", presence(last.select("digest")))
    repeated = seem.filter(F.col("bytes") >= smallest).join(last, "digest").withColumn("revisit", F.coalesce(F.coalesce("id", F.lit(-(1 << 63))) < F.col("last"), F.lit(False)))
    answer = stored(repeated.filter("NOT revisit").select("digest", F.col("id").alias("_id")).distinct(), "warc-answers")
    single = maybe_present(base, "digest", presence(last.select("digest")), present=False)
    mark = F.xxhash64("digest", "id")
    some = maybe_present(base, "digest", presence(last.select("digest"))).withColumn("_mark", mark)
    answers = maybe_present(some, "_mark", presence(answer.select(F.xxhash64("digest", "_id").alias("m")))).join(answer.withColumnRenamed("digest", "_digest"), F.expr("digest = _digest AND id <=> _id"), "left_semi")
    # payloads that seem repeated to the filter, or would be if they were longer, and are not
    others = seem.filter(F.col("bytes") < smallest).unionByName(seem.filter(F.col("bytes") >= smallest).join(last, "digest", "left_anti"))
    others = stored(others.select(F.col("digest").alias("_digest"), F.col("id").alias("_id")).distinct(), "warc-others")
    others = maybe_present(some, "_mark", presence(others.select(F.xxhash64("_digest", "_id").alias("m")))).join(others, F.expr("digest = _digest AND id <=> _id"), "left_semi")
    responses = single.select("id", "url", "digest", "html").unionByName(answers.select("id", "url", "digest", "html")).unionByName(others.select("id", "url", "digest", "html"))
    return _records(responses, False).unionByName(_records(repeated.filter("revisit"), True))


def write(pages: DataFrame, path: str, per_file: int = PER_FILE, **names) -> None:
    with scratch(pages.sparkSession):
        records(pages, **names).write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(path)


def _open(path: str):
    """A random-access file in any store that Arrow knows."""
    store, name = pafs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def _page(value: str) -> int | None:
    text = value.strip("<>").removeprefix("urn:page:")
    return int(text) if text else None


def _head(block: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in block.decode("utf-8").split("\r\n")[1:])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with _open(path) as f:
                size, at, held, held_at, out = f.size(), 0, b"", 0, []
                while at < size:
                    while (cut := held.find(b"\r\n\r\n", at - held_at)) < 0 or cut - (at - held_at) == 0:
                        more = f.read(CHUNK)
                        if not more:
                            raise ValueError(f"{path}: no record at {at}")
                        held, held_at = held[at - held_at:] + more, at
                    head = _head(held[at - held_at:cut])
                    body = held_at + cut + 4
                    length = body - at + int(head["Content-Length"])
                    revisit = head["WARC-Type"] == "revisit"
                    payload = 0 if revisit else int(head["Content-Length"]) - len(HTTP)
                    out.append((path, at, length, _page(head["WARC-Record-ID"]), unquote(head["WARC-Target-URI"]), head["WARC-Type"], _page(head["WARC-Refers-To"]) if revisit else None, head["WARC-Payload-Digest"].removeprefix("sha1:"), length - payload, payload))
                    at += length + len(END)
                    if at - held_at >= len(held):  # the body reaches beyond what is held: go on behind it
                        f.seek(at)
                        held, held_at = b"", at
                    if len(out) >= 5000:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])


def index(spark: SparkSession, path: str) -> DataFrame:
    """The index of all archives under ``path``, stored as a table: one row per record, one task per archive."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    many = max(1, files.count())
    with scratch(spark) as keep:
        files = stored(files.filter("length > 0"), "warc-files")
        return keep(stored(files.select("path").repartition(min(many, 4096)).mapInArrow(_index, INDEX), "warc-index"))


def ranges(rows: list[tuple[int, int]], gap: int = GAP, chunk: int = CHUNK) -> list[tuple[int, int, list[int]]]:
    """(from, to, places in ``rows``): sorted ranges (offset, length), coalesced."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (at, length) in enumerate(rows):
        if out and at - out[-1][1] <= gap and at + length - out[-1][0] <= chunk:
            begin, end, places = out[-1]
            places.append(i)
            out[-1] = (begin, max(end, at + length), places)
        else:
            out.append((at, at + length, [i]))
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by file and offset; each batch's ranges are read in order and yielded ``CHUNK`` bytes at a time.

    All columns are parsed from the records themselves.
    """
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    names = ["page_id", "record_type", "refers_to", "payload", "digest"]
    path, f = None, None
    for batch in batches:
        files = batch.column(0).to_pylist()
        at, length, pay_at = (batch.column(i).to_pylist() for i in range(1, 4))
        begin = 0
        while begin < len(files):
            end = begin
            while end < len(files) and files[end] == files[begin]:
                end += 1
            if files[begin] != path:
                path, f = files[begin], _open(files[begin])
            out, held = [], 0
            for a, b, places in ranges(list(zip(at[begin:end], length[begin:end], strict=True))):
                f.seek(a)
                block = f.read(b - a)
                for i in places:
                    record = block[at[begin + i] - a:at[begin + i] - a + length[begin + i]]
                    head = _head(record[:record.index(b"\r\n\r\n")])
                    claimed = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "revisit":
                        out.append((_page(head["WARC-Record-ID"]), "revisit", _page(head["WARC-Refers-To"]), None, claimed))
                        continue
                    payload = record[pay_at[begin + i]:]
                    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if found != claimed:
                        raise ValueError(f"{path}: the payload at {at[begin + i]} has digest {found}, not {claimed}")
                    out.append((_page(head["WARC-Record-ID"]), "response", None, payload, found))
                held += b - a
                if held >= CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
            begin = end


def read(selected: DataFrame) -> DataFrame:
    """(page_id, record_type, refers_to, payload, digest) of index rows, from their byte ranges.

    A response's digest is that of the bytes read, and has to be what its header claims; a
    revisit record has no payload, and the digest that its header claims.
    """
    rows = selected.select("file", "offset", "length", "payload_at")
    parts = F.floor(F.col("offset") / F.lit(CHUNK * 8))  # a large archive is read by several tasks
    rows = rows.withColumn("_p", parts).repartition("file", "_p").sortWithinPartitions("file", "offset").drop("_p")
    return rows.mapInArrow(_read, "page_id long, record_type string, refers_to long, payload binary, digest string")


def round_trip(pages: DataFrame, **names) -> DataFrame:
    """Write all pages, index the archives, read every record back.

    (page_id, payload_bytes, payload_digest, record_type, refers_to); a revisit has the
    bytes of the response that it refers to.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    try:
        with scratch(spark) as keep:
            write(pages, path, **names)
            got = read(index(spark, path)).select("page_id", F.length("payload").cast("bigint").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
            got = keep(stored(got, "warc-read"))
    finally:  # what was read back is a table of its own
        delete(spark, path)
    own, revisit = got.filter("record_type = 'response'"), got.filter("record_type = 'revisit'").drop("payload_bytes")
    # rows may share an id: the digest in the revisit's own header picks the response
    first = own.filter("page_id IS NOT NULL").select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").distinct()
    first = maybe_present(first, "payload_digest", presence(revisit.select("payload_digest")))
    revisit = revisit.join(first, ["refers_to", "payload_digest"], "left")
    return own.unionByName(revisit.select(own.columns))
