"""WARC archives: writing captures, reading records, assembling transactions.

``write`` stores each capture as a response (or a revisit of an earlier equal
payload), a request and a metadata record; the last two name the first by
WARC-Concurrent-To.  The records are strings that Spark's text writer stores,
whose line separator is the end of a WARC record; so any store that Spark can
write will do, and a lost task is written again.  ``read`` walks the records of
each file by their Content-Length.  ``assemble`` joins the records of a
transaction through their concurrent-to identifiers into one nested row.

Defined cases: a null payload counts as empty; a payload of any length is
stored whole; line ends in a url are percent-encoded, and a null url is stored
as the capture's identifier; captures with the same key are stored one by one
and share their request and metadata records; a null key is stored as such;
an empty table gives an empty archive and an empty result; other columns of the
input are ignored; records of a transaction without a response, revisit or
resource record give no row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, need

#: Equal payloads below this size are stored again.
LEAST_REVISIT = 1_000

#: Bytes that a file may hold, of more than one capture; a reader has one file in memory.
FILE_BYTES = 48_000_000

#: Captures are written by size, so that a count of them bounds a file's bytes;
#: what fields and headers take beside payload and address is ``HEAD_BYTES`` at most.
SIZES = (16_000, 128_000, 1_000_000, 8_000_000, FILE_BYTES)
HEAD_BYTES = 2_000
END = "\r\n\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ANCHORS = ("response", "revisit", "resource")

RECORD = "record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, payload_digest string, payload_bytes bigint, payload_sha1 string, headers map<string,string>, payload binary"


def _record(kind: str, identifier: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    parts = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), identifier]
    for name, value in fields:
        parts += [F.lit(f"\r\n{name}: "), value]
    return F.concat(*parts, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def write(captures: DataFrame, path: str, key: str, url: str, payload: str, least: int = LEAST_REVISIT, date: str = "1970-01-01T00:00:00Z") -> None:
    """Stores the captures; of equal payloads of at least ``least`` bytes, that
    with the largest key is the response and the others revisit it.  A file holds
    ``FILE_BYTES`` at most before compression, or one capture."""
    ws = Workspace(captures.sparkSession, "warc")
    given = need(captures, key, url, payload).toDF("id", "url", "payload")
    given = given.withColumn("payload", F.coalesce(F.col("payload").cast("binary"), F.lit(b"")))
    given = given.withColumn("n", F.octet_length("payload").cast("bigint")).withColumn("same", F.sha1("payload"))
    first = given.filter(F.col("n") >= least).groupBy("same", "n").agg(F.max("id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    first = ws.keep(first.select("same", "n", "first"), "first")  # Spark knows its size, and broadcasts it only if that allows
    # a url is in at most nine fields and lines of the three records, up to three bytes long for one
    taken = F.col("n") + 27 * F.coalesce(F.octet_length("url"), F.lit(0))
    given = given.withColumn("step", sum([(taken > x).cast("int") for x in SIZES], F.lit(0)))
    steps = sorted(r.step for r in given.select("step").distinct().collect())  # a few numbers
    rows = given.join(first, ["same", "n"], "left")
    urn = lambda of, kind: F.concat(F.lit("<urn:capture:"), F.coalesce(of.cast("string"), F.lit("")), F.lit(f":{kind}>"))
    answer = urn(F.col("id"), "response")
    target = F.coalesce(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), F.concat(F.lit("urn:capture:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    about = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", target)]
    digest = [("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("same")))]
    http = [("Content-Type", F.lit("application/http;msgtype=response"))]
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    again = F.coalesce(F.col("first") != F.col("id"), F.lit(False))
    response = F.when(
        again, _record("revisit", answer, [*about, ("WARC-Profile", F.lit(IDENTICAL)), ("WARC-Refers-To", urn(F.col("first"), "response")), *digest, *http], head)
    ).otherwise(_record("response", answer, [*about, *digest, *http], F.concat(head, F.col("payload").cast("string"))))
    concurrent = [("WARC-Concurrent-To", answer)]
    place = F.regexp_extract(target, r"://[^/?#]*([^#]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(place == "", "/").otherwise(place), F.lit(" HTTP/1.1\r\nHost: "), F.regexp_extract(target, "://([^/?#]*)", 1), F.lit(END))
    request = _record("request", urn(F.col("id"), "request"), [*about, *concurrent, ("Content-Type", F.lit("application/http;msgtype=request"))], asked)
    said = F.concat(F.lit("payload-bytes: "), F.col("n").cast("string"), F.lit("\r\n"))
    metadata = _record("metadata", urn(F.col("id"), "metadata"), [*about, *concurrent, ("Content-Type", F.lit("application/warc-fields"))], said)
    for step in steps or [0]:
        per_file = 3 * max(1, FILE_BYTES // (SIZES[step] + HEAD_BYTES)) if step < len(SIZES) else 3
        records = rows.filter(F.col("step") == step).select(F.explode(F.array(response, request, metadata)).alias("value"))
        records.write.options(lineSep=END, compression="gzip", maxRecordsPerFile=per_file, **{"zlib.compress.level": "BEST_SPEED"}).text(f"{path}/size{step}")
    ws.close()


def _inflated(content: bytes, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file, of which gzip members are unpacked piece by piece."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    member = zlib.decompressobj(31)
    rest, at = b"", 0
    while rest or at < len(content):
        if not rest:
            rest, at = content[at : at + chunk], at + chunk
        yield member.decompress(rest)
        rest = member.unused_data
        if member.eof:
            member = zlib.decompressobj(31)


def parse(pieces: Iterable[bytes]) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Header fields and block of each record of an archive."""
    held, pieces = bytearray(), iter(pieces)

    def upto(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        while upto(2) and held[:2] == b"\r\n":  # the end of the last record
            del held[:2]
        if not held:
            return
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not upto(seen + 1):
                raise ValueError("an archive ends inside a record's header")
        lines = held[:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])]
        size = int(dict(fields)["content-length"])
        if not upto(end + 4 + size):
            raise ValueError("an archive ends inside a record's block")
        yield fields, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]


def _row(fields: list[tuple[str, str]], block: bytes) -> dict:
    one = dict(fields)
    kind, size, payload = one.get("warc-type", ""), None, block
    digest = one.get("warc-payload-digest", "")
    if one.get("content-type", "").replace(" ", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        for line in head.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length":
                size = int(value)
    revisit = kind == "revisit"
    if revisit:
        sha1 = digest.removeprefix("sha1:")
    else:
        size, sha1 = len(payload), hashlib.sha1(payload).hexdigest()
    return {
        "record_id": one.get("warc-record-id"), "type": kind, "target_uri": one.get("warc-target-uri"), "date": one.get("warc-date"),
        "concurrent_to": [v for k, v in fields if k == "warc-concurrent-to"], "refers_to": one.get("warc-refers-to"), "payload_digest": digest or None,
        "payload_bytes": size, "payload_sha1": sha1, "headers": list(one.items()), "payload": payload,
    }


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives below ``path``.  Of a revisit, size
    and digest are those of the payload that it stands for; its payload is empty."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.string()] * 4 + [pa.list_(pa.string())] + [pa.string()] * 2 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    schema = pa.schema(list(zip(names, types)))

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                for fields, block in parse(_inflated(batch.column(0)[i].as_py())):
                    rows.append(_row(fields, block))
                    held += len(block) + 1000
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(run, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """``record_id, anchor``: the response, revisit or resource that each other
    record belongs to.  It names that record, is named by it, or names a record
    for which one of these holds."""
    is_anchor = F.col("type").isin(*ANCHORS)
    anchors = records.filter(is_anchor)
    other = records.filter(~is_anchor).select("record_id", F.explode("concurrent_to").alias("to"))
    names = other.join(anchors.select(F.col("record_id").alias("to")).distinct(), "to").select("record_id", F.col("to").alias("anchor"))
    named = anchors.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("anchor"))
    near = names.union(named).distinct()
    far = other.join(near.select("record_id"), "record_id", "left_anti").join(near.withColumnRenamed("record_id", "to"), "to").select("record_id", "anchor")
    return near.union(far.distinct())


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each response, revisit or resource record: its fields,
    and its ``requests`` and ``metadata`` records, as arrays of structs.  The
    records are kept in a table first, so that archives are read once."""
    records = Workspace(records.sparkSession, "warc").keep(records, "records", "zstd")
    is_anchor = F.col("type").isin(*ANCHORS)
    one = F.struct("record_id", "date", "target_uri", "headers", "payload")
    other = records.filter(~is_anchor).join(transactions(records.select("record_id", "type", "concurrent_to")), "record_id").dropDuplicates(["record_id", "anchor"])
    gathered = other.groupBy("anchor").agg(
        F.collect_list(F.when(F.col("type") == "request", one)).alias("requests"), F.collect_list(F.when(F.col("type") == "metadata", one)).alias("metadata")
    )
    none = F.array().cast(gathered.schema["requests"].dataType)
    rows = records.filter(is_anchor).drop("concurrent_to").join(gathered.withColumnRenamed("anchor", "record_id"), "record_id", "left")
    return rows.withColumn("requests", F.coalesce("requests", none)).withColumn("metadata", F.coalesce("metadata", none))


def capture_key(identifier: Column, kind: str = "string") -> Column:
    """The key of the capture that an identifier of ``write`` was made from."""
    found = F.regexp_extract(identifier, r"^<urn:capture:(.*):[a-z]+>$", 1)
    return F.when(found != "", found).cast(kind)
