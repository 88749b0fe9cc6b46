"""WARC archives compressed by Zstandard: one frame per record behind a dictionary in a leading skippable frame.

Writing: one dictionary is trained for the write on a bounded sample of all rows; each Spark partition writes its records
to archives in a shared folder, rolled at a size. A record whose payload equals an earlier one's is written as a revisit
that names the response. Reading: archives are listed and loaded by Spark's binaryFile source; the dictionary comes from
the skippable frame; every frame is decoded alone and its WARC header, lengths and digests are validated, whatever the
record's type and whoever wrote it. resolve_revisits gives revisits the length and digest of the payload they refer to.

Defined results: a null payload is empty; payloads below `least` bytes are never revisits; of equal
payloads the smallest id is the response; rows that repeat an id are written as often as they occur; a row
without an id is a response that nothing refers to; an empty table makes no archive and reads as no record; further
columns are ignored; a broken record raises ArchiveError or, with keep_errors, is a row that says what is wrong with it,
and reading goes on at the next frame. Rows too few or too much alike to train on are written without a dictionary. An
archive is read in one task, its records one after another.
"""
from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: Fixed values of the formats: the skippable frame that holds the dictionary, a dictionary's and a frame's first bytes.
SKIPPABLE, DICTIONARY, FRAME = 0x184D2A5D, b"\x37\xa4\x30\xec", b"\x28\xb5\x2f\xfd"
CRLF = b"\r\n"
DIGESTS = ("sha256", "sha1", "md5", "sha512")
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
RECORDS = "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, stored_bytes long, archive string, record_id string, error string"
#: First ids of repeated payloads that are sent to all executors; with more of them payloads are shuffled by digest.
FEW = 100_000
#: Rows that the dictionary is trained on (twice as many at most), and bytes of each: what reaches the driver of a write.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 8_192, 16_384


class ArchiveError(ValueError):
    """An archive or a record that does not keep the format."""


def record(row_id: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; without an id it is named "none". A revisit holds no payload, but the payload's length and digest."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'none' if row_id is None else row_id}>",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: '%%%02X' % ord(m[0]), uri or '')}",
        "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        f"Content-Length: {len(body)}",
    ]
    return CRLF.join(x.encode() for x in head) + CRLF + CRLF + body + CRLF + CRLF


def _same(written: str, data: bytes) -> bool:
    """Whether a digest field, algorithm:value in hexadecimal or base 32, is that of the data; other algorithms are not checked."""
    name, _, value = written.partition(":")
    if name.lower() not in DIGESTS:
        return True
    own = hashlib.new(name.lower(), data, usedforsecurity=False).digest()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def parse(raw: bytes) -> dict:
    """The record in one frame, with its header, lengths and digests checked. id and refers_to are those of records written
    here (null for others), record_id the record's own name. The payload of an HTTP message is its body."""
    head, gap, rest = raw.partition(CRLF + CRLF)
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(CRLF)
    if not gap or not lines[0].startswith(b"WARC/1."):
        raise ArchiveError(f"no WARC header: {raw[:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ArchiveError(f"no header field: {line[:80]!r}")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.strip().decode("utf-8", "replace")
    for needed in ("warc-type", "warc-record-id", "warc-date", "content-length", *(["warc-profile"] if fields.get("warc-type") == "revisit" else [])):
        if not fields.get(needed):
            raise ArchiveError(f"no {needed}")
    kind, name = fields["warc-type"], fields["warc-record-id"]
    if not re.fullmatch(r"\d+", fields["content-length"]):
        raise ArchiveError(f"{name}: Content-Length {fields['content-length']}")
    size = int(fields["content-length"])
    if rest[size:] != CRLF + CRLF:
        raise ArchiveError(f"{name}: Content-Length {size}, but {len(rest) - 4} bytes are there")
    block = rest[:size]
    if not _same(fields.get("warc-block-digest", ""), block):
        raise ArchiveError(f"{name}: block digest differs")
    payload, coded = block, False
    if fields.get("content-type", "").replace(" ", "").startswith("application/http"):
        http, _, payload = block.partition(CRLF + CRLF)
        coded = b"transfer-encoding" in http.lower()
    digest, full = fields.get("warc-payload-digest", ""), fields.get("x-payload-length")
    if kind == "revisit":
        length = int(full) if full else None
        digest = digest.partition(":")[2].lower() if digest.lower().startswith("sha256:") else None
    else:
        length = len(payload)
        if full is not None and full != str(length):
            raise ArchiveError(f"{name}: {length} of {full} bytes")
        if not coded and not _same(digest, payload):
            raise ArchiveError(f"{name}: payload digest differs")
        digest = hashlib.sha256(payload).hexdigest()
    own, refers = (re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(f, "")) for f in ("warc-record-id", "warc-refers-to"))
    return {"id": own and int(own[1]), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": refers and int(refers[1]), "target_uri": fields.get("warc-target-uri", ""), "stored_bytes": size, "record_id": name, "error": None if kind in TYPES else f"{name}: unknown type {kind}"}


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes | None:
    """A dictionary of at most `size` bytes, an eighth of the samples; None if they are too few or too much alike."""
    import zstandard

    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples).as_bytes() if samples else None
    except zstandard.ZstdError:
        return None


def pack(records: list[bytes], dictionary: bytes | None = None, level: int = 3) -> bytes:
    """An archive behind the dictionary (b"": none), by default one trained on the first records."""
    import zstandard

    dictionary = dictionary if dictionary is not None else train([r[:SAMPLE_BYTES] for r in records[:SAMPLE_ROWS]])
    known = None if not dictionary else zstandard.ZstdCompressionDict(dictionary)
    out = bytearray()
    if known is not None:
        held = zstandard.ZstdCompressor(level=level).compress(dictionary)
        out += struct.pack("<II", SKIPPABLE, len(held)) + held
    writer = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True, write_content_size=True)
    for r in records:
        out += writer.compress(r)
    return bytes(out)


def unpack(content: bytes, broken: Callable[[str], None] | None = None) -> Iterator[bytes]:
    """The decoded frames of an archive, one record each. `broken`, if given, is told of a frame that cannot be decoded,
    and reading goes on where the next one may begin."""
    import zstandard

    at, known = 0, None
    if content[:4] == struct.pack("<I", SKIPPABLE):
        if len(content) < 8 or len(content) < (at := 8 + struct.unpack_from("<I", content, 4)[0]):
            raise ArchiveError("the dictionary's frame is cut short")
        held = content[8:at]
        if held[:4] == FRAME:
            try:
                held = zstandard.ZstdDecompressor().decompress(held)
            except zstandard.ZstdError as e:
                raise ArchiveError(f"the dictionary cannot be decoded: {e}") from None
        if held[:4] != DICTIONARY:
            raise ArchiveError("the leading skippable frame holds no dictionary")
        known = zstandard.ZstdCompressionDict(held)
    reader = zstandard.ZstdDecompressor(dict_data=known)
    view = memoryview(content)

    def frame_at(at: int) -> tuple[bytes, int]:
        step = min(len(content) - at, 1 << 15)
        while True:  # a frame's end is known once it is decoded; longer pieces are tried for longer frames
            frame = reader.decompressobj()
            try:
                raw = frame.decompress(view[at : at + step])
            except zstandard.ZstdError as e:
                raise ArchiveError(f"a frame at byte {at} cannot be decoded: {e}") from None
            if frame.eof:
                return raw, at + step - len(frame.unused_data)
            if at + step >= len(content):
                raise ArchiveError(f"the frame at byte {at} is cut short")
            step = min(len(content) - at, step * 8)

    while at < len(content):
        try:
            raw, at = frame_at(at)
        except ArchiveError as e:
            if broken is None:
                raise
            broken(str(e))
            at = content.find(FRAME, at + 1)
            if at < 0:
                return
            continue
        yield raw


def _write_file(folder: str, name: str, data: bytes) -> str:
    """Write under a name of its own and rename: a repeated task leaves the same file."""
    import uuid

    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, f"{path}/{name}")
    return f"{folder}/{name}"


def mark_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """id, uri, payload, digest, refers_to. The smallest id of a digest is found by an aggregation that combines before the
    shuffle of ids and digests; what it finds is sent to the payloads as long as it is FEW rows, and beyond that joined
    with them, where a digest that many rows share is split by Spark's skew join."""
    rows = pages.select("id", "uri", F.coalesce(F.col("payload"), F.lit("").cast("binary")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    firsts = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    firsts = cut(firsts, "firsts")
    out = rows.join(F.broadcast(firsts) if firsts.count() <= FEW else firsts, "digest", "left")
    return out.select("id", "uri", "payload", "digest", F.when(F.col("first") != F.col("id"), F.col("first")).alias("refers_to"))


def write_archives(marked: DataFrame, folder: str, archive_bytes: int = 64 << 20, sample: DataFrame | None = None) -> DataFrame:
    """Write the rows' records; returns archive, records, bytes. The write happens when the result is acted on, the training
    of its dictionary at once, on about SAMPLE_ROWS rows of `sample` (id, payload; by default the rows) that are chosen by hash."""
    rows = marked if sample is None else sample
    share = max(1, rows.count() // SAMPLE_ROWS)
    # A share of all rows by hash; the limit only bounds what rows of one id or none can add.
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select(F.substring("payload", 1, SAMPLE_BYTES).alias("head")).where(F.octet_length("head") > 0).limit(2 * SAMPLE_ROWS)
    dictionary = train([bytes(r.head) for r in some.collect()])

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pd.DataFrame:
            data = pack(held, dictionary or b"")
            return pd.DataFrame({"archive": [_write_file(folder, f"part-{part:06d}-{n:04d}.warc.zst", data)], "records": [len(held)], "bytes": [len(data)]})

        for b in batches:
            for row_id, uri, payload, digest, refers in zip(b["id"], b["uri"], b["payload"], b["digest"], b["refers_to"]):
                held.append(record(None if row_id is None else int(row_id), uri, bytes(payload), digest, None if refers is None else int(refers)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    n, held, size = n + 1, [], 0
        if held:
            yield flush()

    # Ids travel as text: pandas would make numbers with gaps into floats.
    return marked.withColumns({"id": F.col("id").cast("string"), "refers_to": F.col("refers_to").cast("string")}).mapInPandas(write, "archive string, records long, bytes long")


def read_archives(spark: SparkSession, folder: str, keep_errors: bool = False) -> DataFrame:
    """One row per record of all archives below the folder. keep_errors: a broken one is a row with its `error`."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in RECORDS.split(", ")]
        nothing = dict.fromkeys(names)
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                held: list[dict] = []
                tell = (lambda error: held.append(nothing | {"archive": path, "error": error})) if keep_errors else None  # noqa: B023
                try:
                    for raw in unpack(bytes(content), tell):
                        try:
                            held.append(parse(raw) | {"archive": path})
                        except ArchiveError as e:
                            if not keep_errors:
                                raise
                            tell(str(e))
                        if len(held) >= 5_000:
                            yield _frame(held, names)
                            held = []
                except ArchiveError as e:
                    if not keep_errors:
                        raise
                    tell(str(e))
                if held:
                    yield _frame(held, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInPandas(read, RECORDS)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """The records, with the length and digest of a revisit's payload taken from the response it refers to, and an error
    where that is missing or not what the revisit says. Of several responses of one id the smallest digest counts."""
    asked = records.where("refers_to is not null").select(F.col("refers_to").alias("id")).distinct()
    found = records.where("record_type = 'response'").join(asked, "id", "left_semi").groupBy(F.col("id").alias("refers_to")).agg(F.min(F.struct("payload_digest", "payload_bytes")).alias("of"))
    out = records.join(found, "refers_to", "left")
    here, said = F.col("refers_to").isNotNull(), F.coalesce("payload_digest", F.col("of.payload_digest"))
    error = F.when(here & F.col("of").isNull(), "the response is missing").when(here & ((said != F.col("of.payload_digest")) | (F.coalesce("payload_bytes", F.col("of.payload_bytes")) != F.col("of.payload_bytes"))), "the response's payload is another")
    told = {c: F.when(here, F.col(f"of.{c}")).otherwise(F.col(c)) for c in ("payload_bytes", "payload_digest")}
    return out.withColumns(told | {"error": F.coalesce("error", error)}).select(*records.columns)


def _frame(held: list[dict], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(held, columns=names).astype(object)
    for name in ("id", "refers_to", "payload_bytes", "stored_bytes"):
        out[name] = pd.array([r[name] for r in held], dtype="Int64")
    return out


def make_folder(folder: str) -> str:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return folder
