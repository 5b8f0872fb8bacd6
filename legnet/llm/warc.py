"""Web archives with a two-level capture index.

`write_archives` puts one record per page into gzip members of WARC files, each task its
own files; of equal payloads only one is stored, the others are revisit records.
`build_index` sorts the captures by reversed-host key, writes them as compressed blocks
of lines, and keeps a sparse directory per index shard: the first key of each block with
its place. `lookup` sends every key to its shard, binary-searches the directory, reads one
block by range and binary-searches its lines. `read_records` reads the captures found by
range, in file order.

Files are written through pyarrow's file systems into a folder that all executors
share. A repeated task writes files of a new name; only files that a stored table
of captures names are ever read.

Defined results: a missing html counts as empty and a missing url as the empty key; payloads
under 100 bytes are never revisits; among equal payloads every row with the smallest page
id is a response (repeated rows all are), the others refer to that id, and rows without an
id refer to it too; an empty table gives no archives and no records; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import sha256
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from legnet.llm.batches import map_batches
from legnet.plans.store import cut, work_folder

#: Payloads below this many bytes are always stored.
LEAST_REVISIT = 100
ROLL_BYTES = 64 << 20
BLOCK_LINES = 1000
SHARD_ROWS = 1_000_000
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"

CAPTURE = "key string, page_id long, file string, offset long, length long"


def open_folder(folder: str):
    """(file system, path) of a folder given as a path or a URI."""
    return FileSystem.from_uri(folder)


def surt(url: str | None) -> str:
    """Reversed-host key of a URL: hosts of one domain sort together.

    `https://a.example.org/x?y#z` gives `org,example,a)/x?y`. Text that is no URL is its
    own key; no line break or tab stays in a key.
    """
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = parts.hostname or ""
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    if not host:
        return quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + port + ")" + quote(rest, safe="!$%&'()*+,/:;=?@[]~")


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """The bytes of one record; a revisit (refers_to given) carries no payload."""
    name = "none" if page_id is None else page_id
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if refers_to is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        body = b""
    else:
        body = (
            b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            b"Content-Length: %d\r\n\r\n" % len(payload)
        ) + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a record")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2] if block else b""


def _page(value: str) -> int | None:
    name = value.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


def revisits(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """Digest and smallest id of every payload that several pages share.

    Counts are summed before the shuffle, so a payload of a third of all pages is a
    few rows by then.
    """
    payload = F.coalesce(pages[html], F.lit("")).cast("binary")
    seen = pages.where(F.octet_length(payload) >= LEAST_REVISIT).select(
        F.sha2(payload, 256).alias("of"), pages[id_col].cast("long").alias("id")
    )
    groups = seen.groupBy("of").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    return groups.where((F.col("n") > 1) & F.col("first").isNotNull()).drop("n")


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Writes the archives below `folder` and returns the stored table of captures."""
    shared = cut(revisits(pages, id_col, html))
    payload = F.coalesce(pages[html], F.lit(""))
    rows = pages.select(
        pages[id_col].cast("long").alias("id"),
        pages[url].alias("url"),
        payload.alias("html"),
        F.sha2(payload.cast("binary"), 256).alias("digest"),
    )
    rows = rows.join(shared, rows["digest"] == shared["of"], "left").select(
        "id", "url", "html", "digest",
        F.when(~F.col("first").eqNullSafe(F.col("id")), F.col("first")).alias("refers"),
    )
    arrow = _arrow(CAPTURE)
    names = arrow.names

    def run(batches):
        fs, base = open_folder(folder)
        fs.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                cols = batch.to_pydict()
                found = {n: [] for n in names}
                for i, u, text, digest, refers in zip(*(cols[c] for c in ("id", "url", "html", "digest", "refers"))):
                    if out is None or at >= ROLL_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    raw = record(i, u, text.encode("utf-8", "surrogatepass"), digest, refers)
                    raw = pack.compress(raw) + pack.flush()
                    out.write(raw)
                    for n, v in zip(names, (surt(u), i, name, at, len(raw))):
                        found[n].append(v)
                    at += len(raw)
                if found["file"]:
                    yield pa.RecordBatch.from_pydict(found, schema=arrow)
        finally:
            if out is not None:
                out.close()

    return cut(rows.mapInArrow(run, CAPTURE))


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


class Index:
    """Folder of the blocks, first key of each shard and its file, in order.

    There is one entry per SHARD_ROWS captures: the list that ranges are dealt by.
    """

    def __init__(self, folder: str, firsts: list[tuple], files: list[str]):
        self.folder, self.firsts, self.files = folder, firsts, files


def _turn(key: str, page) -> tuple:
    """Order of captures: by key, then page, pages without an id first."""
    return (key, page is not None, page or 0)


def build_index(captures: DataFrame, folder: str) -> Index:
    """Writes the blocks and directories of all captures, each task a shard."""
    rows = captures.count()
    shards = max(1, -(-rows // SHARD_ROWS), min(rows // 2000, captures.sparkSession.sparkContext.defaultParallelism))
    dealt = captures.repartitionByRange(shards, "key", "page_id", "file", "offset")
    dealt = dealt.sortWithinPartitions("key", "page_id", "file", "offset")
    ddl = "key string, page_id long, file string"
    arrow = _arrow(ddl)

    def run(batches):
        fs, base = open_folder(folder)
        fs.create_dir(base, recursive=True)
        name, out, at, lines, first, directory = f"{uuid.uuid4().hex}.idx", None, 0, [], None, []

        def close_block():
            nonlocal at, lines
            raw = zlib.compress("\n".join(lines).encode(), LEVEL)
            out.write(raw)
            head = lines[0].split("\t")
            directory.append(f"{head[0]}\t{head[1]}\t{at}\t{len(raw)}")
            at, lines = at + len(raw), []

        for batch in batches:
            cols = batch.to_pydict()
            for key, page, file, offset, length in zip(*(cols[c] for c in ("key", "page_id", "file", "offset", "length"))):
                if out is None:
                    out, first = fs.open_output_stream(f"{base}/{name}", compression=None), (key, page)
                lines.append(f"{key}\t{'' if page is None else page}\t{file}\t{offset}\t{length}")
                if len(lines) >= BLOCK_LINES:
                    close_block()
        if out is not None:
            if lines:
                close_block()
            out.close()
            with fs.open_output_stream(f"{base}/{name}.dir", compression=None) as d:
                d.write("\n".join(directory).encode())
            yield pa.RecordBatch.from_pydict(
                {"key": [first[0]], "page_id": [first[1]], "file": [name]}, schema=arrow
            )

    found = cut(dealt.mapInArrow(run, ddl)).collect()  # a row per shard
    found = sorted((_turn(r["key"], r["page_id"]), r["file"]) for r in found)
    return Index(folder, [f for f, _ in found], [n for _, n in found])


class _Shard:
    """Directory of one shard in memory; the block read last is kept."""

    def __init__(self, fs, base: str, name: str):
        self.file = fs.open_input_file(f"{base}/{name}")
        with fs.open_input_stream(f"{base}/{name}.dir", compression=None) as f:
            rows = [line.split("\t") for line in f.read().decode().split("\n")]
        self.heads = [_turn(k, int(p) if p else None) for k, p, _, _ in rows]
        self.places = [(int(a), int(n)) for _, _, a, n in rows]
        self.at, self.lines, self.keys = -1, [], []

    def find(self, key: str, page) -> Iterator[tuple[str, int, int]]:
        """File, offset and length of every capture of a page at a URL, over block edges too."""
        turn = _turn(key, page)
        block = max(0, bisect_left(self.heads, turn) - 1)
        while block < len(self.heads) and self.heads[block] <= turn:
            if block != self.at:
                self.file.seek(self.places[block][0])
                raw = zlib.decompress(self.file.read(self.places[block][1])).decode()
                self.lines = [line.split("\t") for line in raw.split("\n")]
                self.keys = [_turn(x[0], int(x[1]) if x[1] else None) for x in self.lines]
                self.at = block
            for line in self.lines[bisect_left(self.keys, turn) : bisect_right(self.keys, turn)]:
                yield line[2], int(line[3]), int(line[4])
            block += 1


def lookup(index: Index, wanted: DataFrame, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, file, offset, length of every capture of the wanted (url, page).

    Rows wanted several times are looked up once; captures that share a URL and a page,
    or a URL and no page, all come back, from every shard that may hold them.
    """
    ddl = "page_id long, file string, offset long, length long"
    firsts, files, folder = index.firsts, index.files, index.folder
    arrow = _arrow(ddl)

    def route(rows):
        keys = [surt(u) for u in rows["url"]]
        turns = [_turn(k, p) for k, p in zip(keys, rows["page_id"])]
        near = [(max(0, bisect_left(firsts, t) - 1), max(0, bisect_right(firsts, t) - 1)) for t in turns]
        return {"page_id": rows["page_id"], "key": keys, "shards": [list(range(a, b + 1)) for a, b in near]}

    routed = map_batches(
        wanted.select(wanted[id_col].cast("long").alias("page_id"), wanted[url].alias("url")),
        route, StructType.fromDDL("page_id long, key string, shards array<int>"),
    )
    routed = routed.distinct().select("page_id", "key", F.explode("shards").alias("shard"))
    routed = routed.repartitionByRange(max(1, len(files)), "shard", "key", "page_id")
    routed = routed.sortWithinPartitions("shard", "key", "page_id")

    def run(batches):
        fs, base = open_folder(folder)
        at, shard = -1, None
        for batch in batches:
            cols = batch.to_pydict()
            out = {"page_id": [], "file": [], "offset": [], "length": []}
            for page, key, n in zip(cols["page_id"], cols["key"], cols["shard"]):
                if n != at:
                    at, shard = n, _Shard(fs, base, files[n])
                for hit in shard.find(key, page):
                    for c, v in zip(out, (page, *hit)):
                        out[c].append(v)
            if out["page_id"]:
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return routed.mapInArrow(run, ddl)


def read_records(found: DataFrame, folder: str) -> DataFrame:
    """One row per capture, read from its archive by range, in file order.

    The payload's length and digest are taken from the bytes read (a revisit's: from
    its header); a response that does not match its own digest raises an error.
    """
    ddl = (
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )
    arrow = _arrow(ddl)
    session = found.sparkSession
    tasks = int(session.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches):
        fs, base = open_folder(folder)
        name, file = None, None
        for batch in batches:
            cols = batch.to_pydict()
            out = {n: [] for n in arrow.names}
            for where, offset, length in zip(cols["file"], cols["offset"], cols["length"]):
                if where != name:
                    if file is not None:
                        file.close()
                    name, file = where, fs.open_input_file(f"{base}/{where}")
                file.seek(offset)
                headers, payload = parse(zlib.decompress(file.read(length), 31))
                digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                kind = headers["WARC-Type"]
                size = int(headers["X-Payload-Length"])
                if kind == "response" and (sha256(payload).hexdigest() != digest or len(payload) != size):
                    raise ValueError(f"damaged record in {where} at {offset}")
                refers = headers.get("WARC-Refers-To")
                row = (
                    _page(headers["WARC-Record-ID"]), size, digest, kind,
                    None if refers is None else _page(refers),
                )
                for n, v in zip(arrow.names, row):
                    out[n].append(v)
            if out["page_id"]:
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return dealt.mapInArrow(run, ddl)


def round_trip(
    pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Archives all pages below the shared work folder, indexes them and reads all back."""
    folder = f"{work_folder(pages.sparkSession)}/legnet-warc-{uuid.uuid4().hex}"
    captures = write_archives(pages, f"{folder}/archives", id_col, url, html)
    index = build_index(captures, f"{folder}/index")
    found = lookup(index, pages, id_col, url)
    return read_records(found, f"{folder}/archives").withColumnRenamed("page_id", id_col)
