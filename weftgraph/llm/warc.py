"""WARC archives of Zstandard frames: a dictionary first, then one frame a record.

The dictionary lies in a leading skippable frame; each record is one frame,
so a reader can start at any frame. Readers stream frame by frame and check
versions, headers and lengths.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import frame, map_frames, sampled
from weftgraph.plans.stage import materialize, new_path

# Fixed values of the formats: frame magics and record framing.
DICT_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
ZSTD_MAGIC = 0xFD2FB528
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


@dataclass(frozen=True)
class WarcParams:
    """Payloads of at least ``revisit_bytes`` may be revisits; the dictionary is trained on at most ``sample`` pages."""

    revisit_bytes: int = 1000
    sample: int = 400
    sample_bytes: int = 16_384
    dictionary_bytes: int = 32_768
    level: int = 3
    file_bytes: int = 128 << 20


class WarcError(ValueError):
    pass


def record_bytes(kind: str, page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record; a revisit has an empty block and the full payload's digest and length in its headers."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{i}')}>"
    block = payload if kind == "response" else b""
    heads = [("WARC-Type", kind), ("WARC-Record-ID", name(page)), ("WARC-Date", date), ("Content-Type", "text/html; charset=utf-8")]
    if url:
        heads.append(("WARC-Target-URI", "".join(c if c.isprintable() and not c.isspace() else f"%{ord(c):02X}" for c in url)))
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    heads += [("WARC-Payload-Digest", f"sha1:{b32}"), ("X-Page-ID", "" if page is None else str(page)), ("X-Payload-Length", str(len(payload)))]
    if kind == "revisit":
        heads += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers)), ("X-Refers-To-Page", str(refers))]
    heads.append(("Content-Length", str(len(block))))
    head = VERSION.encode() + CRLF + b"".join(f"{k}: {v}".encode() + CRLF for k, v in heads) + CRLF
    return head + block + CRLF + CRLF


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names lower-cased) and block; raises :class:`WarcError` where lengths or headers are wrong."""
    head, sep, rest = raw.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    if not sep or not lines[0].startswith(b"WARC/1."):
        raise WarcError("no WARC header")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name.strip() != name:
            raise WarcError(f"bad header line {line[:40]!r}")
        headers[name.decode("ascii").lower()] = value.strip().decode("utf-8")
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in headers:
            raise WarcError(f"no {need}")
    if not headers["content-length"].isdigit():
        raise WarcError("bad content-length")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != CRLF + CRLF:
        raise WarcError(f"block of {len(rest) - 4} bytes where {size} are announced")
    return headers, rest[:size]


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary


def read_archive(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, one frame at a time.

    A dictionary may itself be a Zstandard frame. Other skippable frames are
    passed over. Truncated frames, frames without a known end and frames with
    more than one record raise.
    """
    fs, inner = _filesystem(path)
    with fs.open_input_stream(inner, compression=None) as f:
        yield from read_frames(f)


def read_frames(f) -> Iterator[tuple[dict[str, str], bytes]]:
    plain = zstandard.ZstdDecompressor()
    tool, first, held = plain, True, b""

    def fill(n: int) -> bool:
        nonlocal held
        while len(held) < n:
            more = f.read(max(1 << 16, n - len(held)))
            if not more:
                return False
            held += more
        return True

    while fill(1):
        if not fill(4):
            raise WarcError("truncated frame")
        (magic,) = struct.unpack_from("<I", held)
        if magic in SKIPPABLE:
            if not fill(8):
                raise WarcError("truncated frame")
            (size,) = struct.unpack_from("<I", held, 4)
            if not fill(8 + size):
                raise WarcError("truncated skippable frame")
            body, held = held[8 : 8 + size], held[8 + size :]
            if magic == DICT_MAGIC:
                if not first:
                    raise WarcError("a dictionary after the first frame")
                if body[:4] == struct.pack("<I", ZSTD_MAGIC):
                    body = plain.decompressobj().decompress(body)
                tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body)) if body else plain
            first = False
            continue
        if magic != ZSTD_MAGIC:
            raise WarcError(f"unknown frame magic {magic:#x}")
        first = False
        one, out = tool.decompressobj(), []
        while True:
            try:
                out.append(one.decompress(held))
            except zstandard.ZstdError as e:
                raise WarcError(f"bad frame: {e}") from e
            if one.eof:
                held = one.unused_data
                break
            held = f.read(1 << 16)
            if not held:
                raise WarcError("truncated frame")
        yield parse_record(b"".join(out))


def plan_records(pages: DataFrame, params: WarcParams = WarcParams(), id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, payload, digest, refers)``: refers is null for responses.

    Of equal payloads of at least ``revisit_bytes`` the largest id is the
    response. Digests with one page are not joined at all; the table of the
    others is read back from files, so Spark broadcasts it only if it is
    small. Null ids come first in that order; rows repeated with the largest
    id are all responses.
    """
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.filter(F.octet_length("payload") >= params.revisit_bytes).groupBy("digest", F.octet_length("payload").alias("bytes"))
    groups = large.agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "bytes", "keep")
    groups = materialize(groups, "payload-groups")
    both = rows.withColumn("bytes", F.octet_length("payload")).join(groups, ["digest", "bytes"], "left")
    refers = F.when(F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep"))
    return both.select("page_id", "url", "payload", "digest", refers.alias("refers"))


def train_dictionary(pages: DataFrame, params: WarcParams, id: str = "page_id", html: str = "html") -> bytes:
    """From the first bytes of a bounded sample of pages; empty if there is too little to learn from."""
    drawn = sampled(pages.select(id, html), F.xxhash64(F.col(id)), params.sample)
    texts = [bytes(r["b"]) for r in drawn.select(F.encode(F.substring(F.coalesce(F.col(html), F.lit("")), 1, params.sample_bytes), "UTF-8").alias("b")).collect()]
    texts = [t for t in texts if t]
    if len(texts) < 16:
        return b""
    try:
        return zstandard.train_dictionary(params.dictionary_bytes, texts).as_bytes()
    except zstandard.ZstdError:
        return b""


WRITTEN = "path string, records long, bytes long"


def write_archives(records: DataFrame, folder: str, dictionary: bytes, params: WarcParams = WarcParams()) -> DataFrame:
    """Write ``folder``/part-*.warc.zst, one or more a task; returns ``(path, records, bytes)``, written once.

    A file gets its name when it is complete; a task that is run again writes
    files of other names, and only files in the returned table count. It is
    also in ``folder``/manifest.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, inner = _filesystem(folder)
        fs.create_dir(inner, recursive=True)
        tool = zstandard.ZstdCompressor(level=params.level, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=params.level)
        out = None
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            nonlocal out
            if out is not None:
                out[0].close()
                fs.move(out[2] + ".open", out[2])
                done.append((f"{folder}/{out[1]}", out[3], out[4]))
                out = None

        for pdf in batches:
            for page, url, payload, digest, refers in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["digest"], pdf["refers"]):
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.zst"
                    out = [fs.open_output_stream(f"{inner}/{name}.open", compression=None), name, f"{inner}/{name}", 0, 0]
                    if dictionary:
                        out[0].write(dictionary_frame(dictionary))
                page, refers = (None if pd.isna(x) else int(x) for x in (page, refers))
                frame = tool.compress(record_bytes("response" if refers is None else "revisit", page, url, bytes(payload), digest, refers))
                out[0].write(frame)
                out[3] += 1
                out[4] += len(frame)
                if out[4] >= params.file_bytes:
                    close()
        close()
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    manifest = f"{folder}/manifest"
    map_frames(records, run, WRITTEN).write.parquet(manifest)
    return records.sparkSession.read.schema(WRITTEN).parquet(manifest)


READ = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def read_archives(files: DataFrame, parallelism: int | None = None) -> DataFrame:
    """Every record of the archives named in ``path`` (``READ``), checked.

    The payload of a revisit is empty here; its length and digest are those
    announced. A response's are computed from its block and must agree with
    its headers. Files are dealt one by one and streamed.
    """
    names = [x.split()[0] for x in READ.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                out: list[tuple] = []
                held = 0
                for headers, block in read_archive(path):
                    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                    size, kind = int(headers["x-payload-length"]), headers["warc-type"]
                    if kind == "response" and (hashlib.sha1(block).hexdigest() != digest or len(block) != size):
                        raise WarcError(f"payload of {headers['warc-record-id']} does not match its digest")
                    page, refers = headers["x-page-id"], headers.get("x-refers-to-page")
                    out.append((int(page) if page else None, headers.get("warc-target-uri"), kind, block, size, digest, int(refers) if refers else None))
                    held += len(block)
                    if len(out) >= 512 or held > 8 << 20:
                        yield frame(out, names)
                        out, held = [], 0
                if out:
                    yield frame(out, names)

    parts = parallelism or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_frames(files.select("path").repartition(parts), run, READ)


def archive_pages(spark: SparkSession, pages: DataFrame, params: WarcParams = WarcParams(), folder: str | None = None) -> DataFrame:
    """Write all pages into archives in the shared folder and read them back.

    One row a row of ``pages``. Null html is an empty payload, null ids and
    urls stay null; of rows equal in id and payload all are responses if that
    id is the group's largest. Pages may be of any length: one is one record.
    An empty table gives an empty one; columns other than the three take no
    part, whatever their names.
    """
    folder = folder or new_path(spark, "warc")
    records = plan_records(pages, params)
    return read_archives(write_archives(records, folder, train_dictionary(pages, params), params))
