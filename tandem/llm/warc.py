"""Web archives: a writer, and a Python data source that reads headers first.

    spark.dataSource.register(WarcSource)
    spark.read.format("warc").option("path", folder).load()

Files are packed into partitions of about equal size. A record's headers are parsed first; if its
type or a header is not wanted, the reader seeks past the payload. Wanted values come from pushed
filters on ``record_type`` and the named headers (with ``spark.sql.python.filterPushdown.enabled``),
or from the options ``types`` and ``payload=false``. With ``verify=true`` payloads are read and held
against their headers, also if they are not returned.
"""

from __future__ import annotations

import base64
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from tandem.llm.common import file_system
from tandem.sources.workspace import stage

SCHEMA = (
    "record_type string, record_id string, target_uri string, payload_digest string,"
    " payload_length long, refers_to string, content_length long, payload binary"
)
#: Columns and the headers they come from.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
#: An extension header: revisit records have no payload to measure.
LENGTH = "x-payload-length"
VERSION = b"WARC/1.1\r\n"
DATE = "2000-01-01T00:00:00Z"
FILE_BYTES, PARTITION_BYTES = 256 << 20, 64 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """A record's bytes. Line breaks in header values become blanks."""
    lines = "".join(f"{k}: {' '.join(v.splitlines())}\r\n" for k, v in headers)
    return b"".join([
        VERSION, lines.encode("utf-8", "surrogatepass"),
        f"Content-Length: {len(payload)}\r\n\r\n".encode(), payload, b"\r\n\r\n",
    ])


def records(file, wanted=None, payload: bool = True) -> Iterator[tuple[dict[str, str], int, bytes | None]]:
    """(headers, content length, payload) of an open file's records; header names in lower case.

    ``wanted(headers)`` decides before the payload is touched; what is not wanted, and every payload
    if they are not asked for, is passed over by a seek. A file that is cut short raises an error.
    """
    start = file.tell()
    size = file.seek(0, io.SEEK_END)
    file.seek(start)

    def skip(n: int) -> None:
        if file.seek(n, io.SEEK_CUR) > size:
            raise ValueError("payload cut short")

    while True:
        line = file.readline()
        while line in (b"\r\n", b"\n"):
            line = file.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {file.tell() - len(line)}")
        headers: dict[str, str] = {}
        while (line := file.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("headers cut short")
            key, _, value = line.decode("utf-8", "replace").partition(":")
            headers[key.strip().lower()] = value.strip()
        n = int(headers["content-length"])
        if wanted is not None and not wanted(headers):
            skip(n)
            continue
        if payload:
            data = file.read(n)
            if len(data) < n:
                raise ValueError("payload cut short")
        else:
            data = None
            skip(n)
        yield headers, n, data


def verify(headers: dict[str, str], payload: bytes) -> None:
    """Raises an error if a response's payload does not have the length and SHA-1 of its headers."""
    if headers.get("warc-type") == "response" and (
        headers.get(LENGTH) != str(len(payload))
        or headers.get("warc-payload-digest") != f"sha1:{digest(payload)}"
    ):
        raise ValueError(f"payload of {headers.get('warc-record-id')} is not that of its headers")


class Files(InputPartition):
    """The archives that one task reads."""

    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.verify = options.get("verify", "false").lower() == "true"
        types = options.get("types")
        self.wanted: list[tuple[str, frozenset[str]]] = (
            [("warc-type", frozenset(types.split(",")))] if types else []
        )

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and IN on columns that are headers; returns the others to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                values = f.value if isinstance(f, In) else [f.value]
                self.wanted.append((HEADERS[f.attribute[0]], frozenset(values)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, path = file_system(self.folder)
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((i.size, i.path) for i in found if i.is_file and i.path.endswith(".warc"))
        packed: list[list[str]] = []
        room = 0
        for size, name in reversed(files):
            if size > room:
                packed.append([])
                room = PARTITION_BYTES
            packed[-1].append(name)
            room -= size
        return [Files(x) for x in packed]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.folder)

        def wanted(headers: dict[str, str]) -> bool:
            return all(headers.get(k) in values for k, values in self.wanted)

        rows, held = [], 0
        for path in partition.paths if partition else ():
            with system.open_input_file(path) as raw, io.BufferedReader(raw, 1 << 16) as file:
                for headers, n, data in records(file, wanted, self.payload or self.verify):
                    if self.verify:
                        verify(headers, data)
                    if not self.payload:
                        data = None
                    length = headers.get(LENGTH)
                    rows.append({
                        **{c: headers.get(h) for c, h in HEADERS.items()},
                        "payload_length": int(length) if length else None,
                        "content_length": n, "payload": data,
                    })
                    held += len(data or b"") + 200
                    if held >= 8 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
        if rows:
            yield batch_of(rows)


def batch_of(rows: list[dict]) -> pa.RecordBatch:
    text = pa.string()
    schema = pa.schema([
        ("record_type", text), ("record_id", text), ("target_uri", text), ("payload_digest", text),
        ("payload_length", pa.int64()), ("refers_to", text), ("content_length", pa.int64()),
        ("payload", pa.binary()),
    ])
    return pa.RecordBatch.from_pylist(rows, schema)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))


def page_urn(page_id: int | None) -> str:
    return "<urn:page:null>" if page_id is None else f"<urn:page:{page_id}>"


def write_pages(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes a record per row of ``pages`` and returns the manifest (path, records, bytes).

    The payload is the html in UTF-8, empty for null. Of records with equal payloads of at least
    ``least_bytes``, the one with the largest page_id is a response and holds the payload; the others
    are revisits that refer to it. Smaller ones are all responses. Null page_ids are smaller than all
    others. Rows with the same page_id and payload are all responses if that page_id is the largest.

    Payloads are compared by digest; a table of a row for each digest that occurs twice is joined, so
    copies are folded in every task first. Each task writes files of its own and renames them when
    they are whole.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url",
        F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    alike = rows.filter(F.length("payload") >= least_bytes).groupBy(F.col("sha1").alias("of")).agg(
        F.max("page_id").alias("response"), F.count("*").alias("n")
    )
    alike = stage(alike.filter("n > 1").select("of", "response"), "alike")
    both = rows.join(alike, F.col("sha1") == F.col("of"), "left").select(
        "page_id", "url", "payload",
        F.coalesce(~F.col("page_id").eqNullSafe(F.col("response")) & F.col("of").isNotNull(), F.lit(False))
        .alias("again"),
        "response",
    )
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        system, path = file_system(folder)
        part, made = TaskContext.get().partitionId(), []
        out, name, n, size = None, None, 0, 0

        def finish() -> None:
            nonlocal out
            out.close()
            final = f"{path}/part-{part:06d}-{len(made):04d}.warc"
            system.move(name, final)
            made.append((final.rpartition("/")[2], n, size))
            out = None

        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for page_id, url, payload, again, response in zip(*columns):
                if out is None:
                    name, n, size = f"{path}/_{uuid.uuid4().hex}", 0, 0
                    out = system.open_output_stream(name)
                    info = record(
                        [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{part}-{len(made)}>"),
                         ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")],
                        b"format: WARC File Format 1.1\r\n",
                    )
                    out.write(info)
                    size += len(info)
                data, is_again = payload.as_py(), again.as_py()
                headers = [
                    ("WARC-Type", "revisit" if is_again else "response"),
                    ("WARC-Record-ID", page_urn(page_id.as_py())),
                    ("WARC-Date", DATE),
                    ("Content-Type", "text/html; charset=utf-8"),
                    ("WARC-Payload-Digest", f"sha1:{digest(data)}"),
                    ("X-Payload-Length", str(len(data))),
                ]
                if url.as_py() is not None:
                    headers.append(("WARC-Target-URI", url.as_py()))
                if is_again:
                    headers.append(("WARC-Refers-To", page_urn(response.as_py())))
                    headers.append((
                        "WARC-Profile",
                        "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                    ))
                made_record = record(headers, b"" if is_again else data)
                out.write(made_record)
                n, size = n + 1, size + len(made_record)
                if size >= FILE_BYTES:
                    finish()
        if out is not None:
            finish()
        columns = list(zip(*made)) or [[]] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))],
            names=["path", "records", "bytes"],
        )

    return stage(both.mapInArrow(write, "path string, records long, bytes long"), "archives")


def read_records(
    spark: SparkSession, folder: str, payload: bool = True, verify: bool = False
) -> DataFrame:
    """The response and revisit records of a folder of archives; other types are passed over.

    With ``verify`` a response whose payload has another length or SHA-1 than its headers say is an
    error.
    """
    spark.dataSource.register(WarcSource)
    # Spark asks Python sources for filters only if told so.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return (
        spark.read.format("warc").option("path", folder).option("types", "response,revisit")
        .option("payload", str(payload).lower()).option("verify", str(verify).lower()).load()
    )


def page_of(urn):
    """The page_id in a record's name; null for null and for the name of a null page_id."""
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
