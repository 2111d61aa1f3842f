"""WARC archives: a writer made of Spark's text sink, and a Python data source that reads headers before payloads.

Writing: a record is one string, its header block and the payload; records end with two CRLFs, which is what the text
sink puts between rows. So the sink's own commit protocol, retries and file systems serve, and no task holds more
than a record. Which record of equal payloads is the response is settled by a grouped maximum over digests alone.

Reading: `spark.read.format("warc")`. The driver lists the files and packs them into partitions by size. Filters on
record_type and on header columns are pushed into the reader, which parses the header block, decides, and seeks over
the payloads it doesn't need.
"""

from __future__ import annotations

import gzip
import hashlib
from base64 import b32encode
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull

from sketchmeans.llm.common import checkpoint, join_counted, materialize, new_path, text_of

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
#: Revisits up to this number are broadcast to the pages, some 100 bytes each; more are joined by a shuffle.
BROADCAST_REVISITS = 200_000
#: Date of the records, a parameter of the writer: the same table gives the same bytes.
DATE = "2024-01-01T00:00:00Z"
SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, block_digest_ok boolean, content_length long, payload binary"
#: Header of each column that a filter can be pushed down for.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
BATCH_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of(digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: 5 hex digits are 20 bits, or 4 characters."""

    def quad(g: Column) -> Column:
        bits = F.conv(F.substring(digest, g * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.concat(*[quad(F.lit(g)) for g in range(8)])


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0, date: str = DATE, compression: str = "none") -> str:
    """Writes one record a row under `path`: a response, or a revisit that refers to the response with the same payload.

    Of rows with equal payloads of at least `min_bytes` bytes the largest id is the response; smaller payloads are always
    responses. Null payloads are empty; line breaks in a URL become spaces, a null URL is empty. Rows that repeat the
    largest id are responses each; rows without an id rank below all others. An empty table writes an empty folder; other
    columns are left out. `compression` may be "gzip".
    """
    rows = pages.select(F.col(id_col).alias("id"), F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), "[\r\n]+", " ").alias("uri"), text_of(body_col).alias("body"))
    rows = rows.select("*", F.sha1("body").alias("hex"), F.octet_length("body").cast("long").alias("bytes"))
    first = rows.groupBy("hex", "bytes").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("bytes") >= min_bytes))
    # An id may come with several payloads, so the digest is part of the key.
    again = checkpoint(join_counted(rows.select("id", "hex", "bytes"), materialize(first, "responses"), ["hex", "bytes"], width=120).where(~F.col("id").eqNullSafe(F.col("first"))).select(F.col("id").alias("id_"), "first", F.col("hex").alias("hex_")).distinct())
    few = F.broadcast(again) if again.count() <= BROADCAST_REVISITS else again
    joined = rows.join(few, F.col("id").eqNullSafe(F.col("id_")) & (F.col("hex") == F.col("hex_")), "left").select("id", "uri", "body", "first", F.col("hex_").isNotNull().alias("revisit"), base32_of(F.col("hex")).alias("digest"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        record_id(F.col("id")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.col("uri"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(F.col("revisit"), F.concat(F.lit("\r\nWARC-Refers-To: "), record_id(F.col("first")), F.lit(f"\r\nWARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Length: "),
        F.when(F.col("revisit"), F.lit(0)).otherwise(F.octet_length("body")).cast("string"),
        F.lit(END),
    )
    joined.select(F.concat(head, F.when(F.col("revisit"), "").otherwise(F.col("body"))).alias("value")).write.option("lineSep", END).text(path, compression=compression)
    return path


def open_path(path: str):
    """File system and path within it, for any URI that Arrow knows (file, hdfs, s3, gs)."""
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = path.replace("file:", "file://", 1)
    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(tuple(paths))


class WarcSource(DataSource):
    """`spark.read.format("warc").load(folder)`.

    Options: payload (default true; false leaves that column null and never reads payloads that needn't be verified),
    verify (default false; true compares the payload with its digest), partition_mb (default 128).
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path", "")
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.most = float(options.get("partition_mb", "128")) * 2**20
        self.allowed: dict[str, set[str]] = {}
        self.present: set[str] = set()

    def pushFilters(self, filters):
        """Takes equality, IN and IS NOT NULL on header columns; the rest is left to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if name in HEADERS and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.allowed[name] = self.allowed.get(name, values) & values
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.present.add(name)
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, root = open_path(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        packs: list[list[str]] = []
        room = 0.0
        for x in sorted(found, key=lambda x: x.path):
            if x.type != fs.FileType.File or x.base_name[0] in "._" or not x.size:
                continue
            if not packs or x.size > room:
                packs.append([])
                room = self.most
            packs[-1].append(x.path)
            room -= x.size
        return [Files(p) for p in packs] or [Files([])]

    def read(self, partition) -> Iterator[tuple]:
        system, _ = open_path(self.path)
        for path in partition.value:
            with system.open_input_file(path) as f:
                yield from packed(self.records(gzip.GzipFile(fileobj=f) if path.endswith(".gz") else f))

    def records(self, raw) -> Iterator[tuple]:
        """Rows of one archive; raises ValueError where a record is cut off or has no valid header."""
        f = Buffered(raw)
        while (first := f.line()) is not None:
            if not first:
                continue
            if not first.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {first[:40]!r}")
            head: dict[str, str] = {}
            while line := f.line():
                name, _, value = line.partition(b":")
                head[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
            length = int(head.get("content-length", "0"))
            row = [head.get(h) for h in HEADERS.values()]
            got = dict(zip(HEADERS, row, strict=True))
            if any(got[c] not in v for c, v in self.allowed.items()) or any(got[c] is None for c in self.present):
                f.skip(length)
                continue
            body = ok = None
            if self.payload or self.verify:
                body = f.take(length)
                if self.verify and got["payload_digest"] and got["record_type"] != "revisit":
                    ok = got["payload_digest"].removeprefix("sha1:") == b32encode(hashlib.sha1(body).digest()).decode()
            else:
                f.skip(length)
            yield (*row, ok, length, body if self.payload else None)


def packed(rows: Iterator[tuple]) -> Iterator:
    """Arrow batches of at most some BATCH_BYTES of payload, or one record."""
    import pyarrow as pa

    kinds = [pa.string()] * len(HEADERS) + [pa.bool_(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or b"") + 500
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(kinds)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(kinds)], names)


class Buffered:
    """Lines and exact reads over a seekable file; over a gzip file (of one member or many) a seek reads on."""

    STEP = 1 << 20

    def __init__(self, raw):
        self.raw, self.data, self.at = raw, b"", 0

    def fill(self) -> bool:
        more = self.raw.read(self.STEP)
        self.data, self.at = self.data[self.at :] + more, 0
        return bool(more)

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        while (end := self.data.find(b"\n", self.at)) < 0:
            if not self.fill():
                rest, self.at = self.data[self.at :], len(self.data)
                return rest or None
        out, self.at = self.data[self.at : end], end + 1
        return out.removesuffix(b"\r")

    def take(self, n: int) -> bytes:
        have = self.data[self.at : self.at + n]
        self.at += len(have)
        if len(have) < n:
            have += self.raw.read(n - len(have))
        if len(have) < n:
            raise ValueError("a record is cut off")
        return have

    def skip(self, n: int) -> None:
        have = min(n, len(self.data) - self.at)
        self.at += have
        if n > have:
            self.raw.seek(self.raw.tell() + n - have)


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    """The records under a path; load anew for each set of filters, since Spark keeps those it has pushed with the relation.

    A folder without archives has no records; empty and hidden files are passed over, an archive that is cut off or has no valid
    header raises ValueError where it is read. Records that repeat are all returned; headers that lack are null.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(**{k: str(v).lower() for k, v in options.items()}).load(path)


def resolve(responses: DataFrame, revisits: DataFrame) -> DataFrame:
    """All records with length and digest of their full payload, which a revisit takes from the response it refers to.

    Of responses both hold only if the payload has been read and has that digest, so they must be read with `verify`. The two frames must come from two calls of read_warc(): Spark keeps pushed filters with the loaded relation, so two
    filters on one loaded frame would meet in one reader. A revisit whose response isn't there, or has another digest than
    the revisit names, has a null length. Revisits are counted by response, so that those of one are not one task's.
    """
    names = ["record_id", "record_type", "target_uri", "refers_to", "payload_digest", "full_length"]
    on = ["refers_to", "payload_digest"]
    sound = lambda c: F.when(F.col("block_digest_ok"), F.col(c))
    whole = materialize(responses.select("record_id", "record_type", "target_uri", "refers_to", sound("payload_digest").alias("payload_digest"), sound("content_length").alias("full_length")), "read-responses")
    again = materialize(revisits.select("record_id", "record_type", "target_uri", *on), "read-revisits")
    length = whole.groupBy(F.col("record_id").alias("refers_to"), "payload_digest").agg(F.max("full_length").alias("full_length"))
    known = materialize(again.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).join(length, on), "referred")
    return whole.select(names).unionByName(join_counted(again, known, on, "left", width=160).select(names))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes,
  (SELECT string_agg(substr('{BASE32}', (((('0x' || substr(hex, g * 5 + 1, 5))::BIGINT >> s) & 31) + 1)::BIGINT, 1), '' ORDER BY g, s DESC)
   FROM range(8) a(g), (VALUES (15), (10), (5), (0)) b(s)) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM m
"""


def op10_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = write_warc(pages, new_path(spark, "warc"))
    # Every payload is read and hashed; what fails the check of its digest has neither digest nor length here.
    records = resolve(*[read_warc(spark, path, payload=False, verify=True).where(F.col("record_type") == kind) for kind in ("response", "revisit")])
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    to_long = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return records.select(to_long("record_id").alias("page_id"), F.col("full_length").alias("payload_bytes"), F.expr("substring(payload_digest, 6)").alias("payload_digest"), "record_type", to_long("refers_to").alias("refers_to"))
