"""WARC archives, index first.

Writing makes one archive per task and file, a gzip member per record, and an
index row per record: file, offset, length, URL and digest.  The index is a
table of its own; a selection of it is enough to read records back: rows are
sorted by file and offset, neighbouring byte ranges are coalesced into one
read, and each record is checked against its digest.

A payload of at least ``LEAST_PAYLOAD`` bytes is stored once; later pages with
equal payload get a revisit record that refers to it.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import cut, new_folder, small_batches

LEAST_PAYLOAD = 100
#: A file is closed beyond this size; ranges closer than GAP are read as one, up to SPAN bytes.
FILE_BYTES, GAP, SPAN = 256 << 20, 64 << 10, 8 << 20
INDEX = (
    "file string, offset long, length long, page_id long, url string, payload_bytes long, payload_digest string,"
    " record_type string, refers_to long"
)


_UNSAFE = re.compile(r"[\s\x00-\x1f\x7f-\x9f]")
_ESCAPED = re.compile(r"[\s\x00-\x1f\x7f-\x9f%]")


def _store(folder: str):
    """(file system, path) of a folder by URI; works for local, shared and object stores."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:/", "file:///", 1))


def _uri_fields(url: str | None) -> list[str]:
    """Header lines of a URL: none if null; one with white space or control characters is escaped, and says so."""
    if url is None:
        return []
    if not _UNSAFE.search(url):
        return [f"WARC-Target-URI: {url}"]
    escaped = _ESCAPED.sub(lambda m: quote(m[0], safe="", errors="surrogatepass"), url)
    return [f"WARC-Target-URI: {escaped}", "X-Target-URI-Escaped: yes"]


def target_uri(fields: dict[str, str]) -> str | None:
    """The URL of a record's header fields, as it was written."""
    uri = fields.get("warc-target-uri")
    return unquote(uri, errors="surrogatepass") if uri and fields.get("x-target-uri-escaped") else uri


def record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; ``payload`` None makes a revisit record."""
    kind = "response" if payload is not None else "revisit"
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *_uri_fields(url),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {size}",
    ]
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    body = payload or b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block


def _writer(folder: str):
    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for rows in found:
                made = []
                for page_id, url, html, size, digest, kind, refers in rows.itertuples(index=False, name=None):
                    if out is None or at > FILE_BYTES:
                        if out is not None:
                            out.close()
                        # a task that runs again writes files of its own; the index names only those of the one that ended
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    whole = lambda x: None if pd.isna(x) else int(x)
                    payload = None if kind == "revisit" else html.encode("utf-8", "surrogatepass")
                    raw = gzip.compress(record(whole(page_id), url, payload, size, digest, whole(refers)), 6, mtime=0)
                    out.write(raw)
                    made.append((name, at, len(raw), page_id, url, size, digest, kind, refers))
                    at += len(raw)
                frame = pd.DataFrame(made, columns=[c.split()[0] for c in INDEX.split(", ")])
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> tuple[str, DataFrame]:
    """Write a record per row of ``pages``; (folder, index).  The archives stay until their owner deletes the folder.

    Null html is an empty payload.  Of records with equal payloads of at least
    100 bytes the one with the least page_id is the response, the others
    revisit it (rows that repeat that page_id are responses too; a null id is a
    response only where the group has no id).  Other columns are ignored.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or new_folder(spark, "warc")
    keyed = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html")
    ).select(
        "*",
        F.octet_length("html").cast("long").alias("payload_bytes"),
        F.sha2(F.col("html").cast("binary"), 256).alias("payload_digest"),
    )
    groups = (
        keyed.where(F.col("payload_bytes") >= LEAST_PAYLOAD)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
        .where("n > 1 and least is not null")
    )
    # a table: so both sides of the join are plain exchanges, and Spark can split a payload of very many pages
    groups = cut(groups, "payload-groups")
    again = F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least"))
    typed = keyed.join(groups, ["payload_digest", "payload_bytes"], "left").select(
        "page_id",
        "url",
        F.when(~again, F.col("html")).otherwise("").alias("html"),
        "payload_bytes",
        "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("least")).alias("refers_to"),
    )
    return folder, cut(typed.mapInPandas(_writer(folder), INDEX), "warc-index")


def ranges(rows: list[tuple[str, int, int]], gap: int = GAP, span: int = SPAN) -> list[tuple[int, int]]:
    """Runs (first, past last) of sorted (file, offset, length) rows that one read covers."""
    out, first = [], 0
    for k in range(1, len(rows) + 1):
        if k < len(rows):
            f, o, n = rows[k]
            pf, po, pn = rows[k - 1]
            if f == pf and o - (po + pn) <= gap and o + n - rows[first][1] <= span:
                continue
        if k > first:
            out.append((first, k))
        first = k
    return out


READ = (
    "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string,"
    " refers_to long"
)


def _reader(folder: str, with_payload: bool):
    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(folder)
        for rows in found:
            keys = list(zip(rows["file"], rows["offset"], rows["length"], strict=True))
            digests = rows["payload_digest"].tolist()
            made = []
            for a, b in ranges(keys):
                name, begin = keys[a][0], keys[a][1]
                with store.open_input_file(f"{root}/{name}") as f:
                    raw = f.read_at(keys[b - 1][1] + keys[b - 1][2] - begin, begin)
                for k in range(a, b):
                    at = keys[k][1] - begin
                    fields, block = parse(gzip.decompress(raw[at : at + keys[k][2]]))
                    kind = fields["warc-type"]
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    if digest != digests[k] or (kind == "response" and hashlib.sha256(block).hexdigest() != digest):
                        raise ValueError(f"record at {name}:{keys[k][1]} doesn't match its digest")
                    number = lambda s: int(x) if (x := s.removeprefix("<urn:page:").removesuffix(">")) else None
                    made.append((
                        number(fields["warc-record-id"]), target_uri(fields), block if with_payload and kind == "response" else None,
                        int(fields["warc-payload-length"]), digest, kind, number(fields["warc-refers-to"]) if kind == "revisit" else None,
                    ))
            frame = pd.DataFrame(made, columns=[c.split()[0] for c in READ.split(", ")])
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    return run


def read_records(folder: str, index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records that ``index`` (or any selection of its rows) names, read and checked; one row each.

    URLs come back as they were written, null ones as null; ``payload`` is null for revisits (the record they refer to
    holds it) and without ``with_payload``.  An empty selection gives an empty result; a row that the index repeats is
    read again.  A record that doesn't match the index's digest raises.
    """
    sorted_rows = index.repartition("file").sortWithinPartitions("file", "offset")
    return sorted_rows.mapInPandas(_reader(folder, with_payload), READ)
