"""Web archives with a two-level capture index.

Pages are written as WARC records, one gzip member each.  The index holds one
line per capture under its reversed-host URL key, sorted; lines are packed in
compressed blocks, and a sparse directory holds the first key of every block.
A look-up searches the directory, reads one range of the index, searches the
block, and reads one range of the archive.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections import OrderedDict
from urllib.parse import urlsplit

import pandas as pd
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordsearch.llm.common import attach, checkpointed, new_folder, parts

#: Payloads below this size are never revisits.
LEAST_PAYLOAD = 100
#: Captures in a block of the index.
BLOCK = 256
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, page_id long, record_type string, file string, offset long, length long"
SHARD = "first_key string, first_id long, last_key string, last_id long, index string, directory string, captures long"
RECORD = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
          "refers_to long, payload binary")


def url_key(url: str | None) -> str:
    """Reversed-host key: ``http://www.a.org/x?y`` gives ``org,a,www)/x?y``; ``-`` without an address."""
    if not url:
        return "-"
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    try:
        parts = urlsplit(clean)
        host = parts.hostname or ""
    except ValueError:  # brackets that are no address
        return f")/{clean}"
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}){tail}"


def _file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in folder and folder.startswith("file:"):
        folder = folder.replace("file:", "file://", 1)
    return pafs.FileSystem.from_uri(folder)


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def pack_record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One record as a gzip member; a revisit holds digest and length, but no payload."""
    digest = hashlib.sha256(payload).hexdigest()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}",
             f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is not None:  # line breaks would end the header
        lines.append("WARC-Target-URI: " + re.sub(r"[%\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}",
                  f"WARC-Profile: {PROFILE}"]
        payload = b""
    head = "\r\n".join([*lines, f"Content-Length: {len(payload)}", "", ""]).encode("utf-8", "surrogatepass")
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head + payload + b"\r\n\r\n") + packer.flush()


def read_record(member: bytes) -> dict:
    """What pack_record wrote; a payload that misses its digest raises ValueError."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    payload = rest[:int(fields["Content-Length"])]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload and digest differ in {fields['WARC-Record-ID']}")
    url = fields.get("WARC-Target-URI")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page-ID"), "url": url and re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url),
            "payload_bytes": len(payload) if kind == "response" else int(fields["X-Payload-Length"]),
            "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page"), "payload": payload}


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url",
                   html: str = "html") -> DataFrame:
    """Write one record per row below ``folder``; returns the captures (see CAPTURE).

    Of rows with equal payloads of at least 100 bytes, those with the smallest
    page id are responses (the row and its exact repeats), the others are
    revisits of it.  Null html is an empty payload; a null page id is written
    as none, and is never referred to.  Each task writes a file of its own
    name, so a task that runs again leaves no half file in the result.
    """
    bytes_ = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), bytes_.alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= LEAST_PAYLOAD, F.sha2("payload", 256)))
    groups = checkpointed(
        rows.where("digest IS NOT NULL").groupBy("digest")
        .agg(F.count("*").alias("n"), F.min("page_id").alias("first_id")).where("n > 1"))
    rows = attach(rows, groups, "digest", "page_id", "n").withColumn(
        "refers_to", F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id")))
    rows = rows.select("page_id", "url", "payload", "refers_to")

    def write(batches):
        system, path = _file_system(folder)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz"
        system.create_dir(path, recursive=True)
        offset = 0
        with system.open_output_stream(f"{path}/{name}", compression=None) as out:
            for batch in batches:
                found = []
                for number, address, payload, refers in zip(
                        batch["page_id"], batch["url"], batch["payload"], batch["refers_to"], strict=True):
                    number, refers = (None if pd.isna(x) else int(x) for x in (number, refers))
                    address = address if isinstance(address, str) else None
                    member = pack_record(number, address, payload, refers)
                    out.write(member)
                    found.append((url_key(address), number, "response" if refers is None else "revisit", name,
                                  offset, len(member)))
                    offset += len(member)
                if found:
                    frame = pd.DataFrame(found, columns=["key", "page_id", "record_type", "file", "offset", "length"])
                    yield frame.astype({"page_id": "Int64"})

    return checkpointed(rows.mapInPandas(write, CAPTURE))


def write_index(captures: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """Write the two-level index below ``folder``; returns its shards (see SHARD).

    Captures are cut into ranges by key, page id and place, so a key with very
    many captures is spread over several shards.  Null page ids sort first.
    """
    order = ["key", "page_id", "file", "offset"]

    def write(batches):
        system, path = _file_system(folder)
        context = TaskContext.get()
        name = f"index-{context.partitionId():05d}-{context.taskAttemptId()}"
        system.create_dir(path, recursive=True)
        offset, total, first, last, pending, directory = 0, 0, None, None, [], []
        with system.open_output_stream(f"{path}/{name}.cdx.gz", compression=None) as out:
            def flush():
                nonlocal offset
                member = gzip.compress("\n".join("\t".join(map(str, x)) for x in pending).encode("utf-8", "surrogatepass"), 1)
                out.write(member)
                directory.append((*pending[0][:2], offset, len(member)))
                offset += len(member)
                pending.clear()

            for batch in batches:
                batch["page_id"] = batch["page_id"].fillna(-1 << 63).astype("int64")
                for line in batch[[*order, "length", "record_type"]].itertuples(index=False, name=None):
                    first = first or line[:2]
                    last = line[:2]
                    pending.append(line)
                    total += 1
                    if len(pending) == block:
                        flush()
            if pending:
                flush()
        if total:
            with system.open_output_stream(f"{path}/{name}.dir") as out:
                out.write("\n".join("\t".join(map(str, x)) for x in directory).encode("utf-8", "surrogatepass"))
            yield pd.DataFrame([(*first, *last, f"{name}.cdx.gz", f"{name}.dir", total)], columns=[
                "first_key", "first_id", "last_key", "last_id", "index", "directory", "captures"])

    sorted_ = captures.select(*order, "length", "record_type").repartitionByRange(parts(captures), *order).sortWithinPartitions(*order)
    return checkpointed(sorted_.mapInPandas(write, SHARD))


class _Reader:
    """Range reads with a few open files kept."""

    def __init__(self, folder: str, most: int = 16):
        self.system, self.path = _file_system(folder)
        self.most, self.open = most, OrderedDict()

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) == self.most:
                self.open.popitem(last=False)[1].close()
            self.open[name] = self.system.open_input_file(f"{self.path}/{name}")
        self.open.move_to_end(name)
        return self.open[name].read_at(length, offset)

    def whole(self, name: str) -> bytes:
        with self.system.open_input_file(f"{self.path}/{name}") as f:
            return f.read()


def _lines(raw: bytes) -> list[list[str]]:
    return [x.split("\t") for x in raw.decode("utf-8", "surrogatepass").split("\n")]


class CaptureIndex:
    """Look-ups in a written index; keeps one directory and one block at a time."""

    def __init__(self, shards: list[tuple], folder: str):
        self.shards = sorted(shards)
        self.lasts = [x[2:4] for x in self.shards]
        self.reader = _Reader(folder)
        self.directory: tuple = (None, [], [])
        self.block: tuple = (None, [])

    def captures(self, key: str, page_id: int):
        """Lines (key, page id, file, offset, length, type) of this key and page id."""
        wanted = (key, page_id)
        for shard in self.shards[bisect.bisect_left(self.lasts, wanted):]:
            if shard[:2] > wanted:
                return
            if self.directory[0] != shard[5]:
                lines = [(x[0], int(x[1]), int(x[2]), int(x[3])) for x in _lines(self.reader.whole(shard[5]))]
                self.directory = (shard[5], lines, [x[:2] for x in lines])
            _, lines, firsts = self.directory
            for at in range(max(bisect.bisect_left(firsts, wanted) - 1, 0), len(lines)):
                if firsts[at] > wanted:
                    break
                place = (shard[4], *lines[at][2:])
                if self.block[0] != place:
                    raw = gzip.decompress(self.reader.read(*place))
                    self.block = (place, [(x[0], int(x[1]), x[2], int(x[3]), int(x[4]), x[5]) for x in _lines(raw)])
                block = self.block[1]
                i = bisect.bisect_left(block, wanted, key=lambda x: x[:2])
                while i < len(block) and block[i][:2] == wanted:
                    yield block[i]
                    i += 1


def read_captures(requests: DataFrame, shards: DataFrame, archives: str, index: str) -> DataFrame:
    """The records (see RECORD) of the distinct (key, page_id) of ``requests``.

    The list of shards has one row per task that wrote the index and goes to
    every task.  Requests are sorted like the index, so a task walks through
    neighbouring blocks.  A request without a capture gives no row.
    """
    master = [tuple(r) for r in shards.collect()]  # one row per index task

    def read(batches):
        look, files = CaptureIndex(master, index), _Reader(archives)
        for batch in batches:
            found = []
            for key, number in zip(batch["key"], batch["page_id"], strict=True):
                for line in look.captures(key, int(number)):
                    found.append(read_record(files.read(*line[2:5])))
                    if len(found) == 1000:
                        yield _frame(found)
                        found = []
            if found:
                yield _frame(found)

    wanted = requests.select("key", F.coalesce("page_id", F.lit(-1 << 63)).alias("page_id")).distinct()
    return wanted.repartitionByRange(parts(wanted), "key", "page_id").sortWithinPartitions("key", "page_id").mapInPandas(read, RECORD)


def _frame(records: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(records).astype({"page_id": "Int64", "refers_to": "Int64"})


def op6_capture_index(spark, sf_dir) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    archives, index = new_folder(spark, "warc"), new_folder(spark, "cdx")
    captures = write_archives(pages, archives)
    shards = write_index(captures, index)
    return read_captures(captures, shards, archives, index).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha256(payload) AS digest FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first_id FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM f
"""
