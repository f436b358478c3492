"""WARC archives with a globally ordered capture index, by external index merge.

Writing: each task writes its records, a gzip member each, to one archive, and sorts its captures by URL
key and timestamp: a locally sorted run. Merging: the key space is cut into ranges at sampled captures
(URL key, timestamp and page, so one URL with very many captures is cut as well); each range gets its
slice of every run and merges the k slices with a loser tree. Ranges in order, and rows in a range, give
the capture histories of all URLs in order. Reading: index rows are dealt out by stretches of archives, and records
that lie side by side in one are read at once.

Of records with equal payloads of at least ``min_revisit`` bytes, that with the largest page id is the
response; the others are revisits of it, without the payload.

Archives are written under a name of the task attempt and then renamed, so a task that runs again leaves
the same files. Defined results: null html is an empty payload; a null URL is about:blank; rows with the
page id of the response are responses too. No rows give no files. A page of any length is one record, which one task holds in memory. Only
the named columns are read, so no other column can clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice
from urllib.parse import urlsplit

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, scratch, shuffle_partitions

#: Seconds since 1970 of the first capture; a capture's time is this plus its page id unless given.
FIRST_CAPTURE = 1_577_836_800
#: Captures sampled from all runs together to cut the key space; at least four for each range.
SAMPLES = 16_384
#: Captures in a range, about; keys of a slice in hand at once.
RANGE_ROWS = 250_000
AHEAD = 2_000
LEVEL = 5
#: Bytes of an archive that one task reads on end, and of one read.
SPAN_BYTES, READ_BYTES = 64 << 20, 8 << 20
INDEX = "url_key string, timestamp string, page_id long, url string, file string, offset long, length long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """Sort key: host labels reversed, then path and query in lower case, without scheme, www and fragment."""
    try:
        u = urlsplit(url.strip())
        host = re.sub(r"^www\d*\.", "", (u.hostname or "").lower())
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    query = "&".join(sorted(u.query.lower().split("&"))) if u.query else ""
    return ",".join(reversed(host.split("."))) + ")" + (u.path.lower().rstrip("/") or "/") + ("?" + query if query else "")


def _stamp(seconds: int) -> tuple[str, str]:
    """(14 digits, ISO form) of a UTC time."""
    from datetime import datetime, timedelta

    t = datetime(1970, 1, 1) + timedelta(seconds=seconds)
    return t.strftime("%Y%m%d%H%M%S"), t.strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str, payload: bytes, seconds: int, kind: str, refers_to: int | None) -> bytes:
    """An uncompressed WARC/1.1 record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {url}", f"WARC-Date: {_stamp(seconds)[1]}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers (lower case), payload length and payload of a record; checks lengths and digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    h = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(h["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record of the wrong length")
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"(?i)\r\nContent-Length: (\d+)", http)[1])
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    if h["warc-type"] == "response" and (len(payload) != n or payload_digest(payload) != digest):
        raise ValueError("a payload that differs from its digest")
    page = lambda k: int(h[k][10:-1]) if h.get(k, "<urn:page:>") != "<urn:page:>" else None
    return {"page_id": page("warc-record-id"), "url": h["warc-target-uri"], "type": h["warc-type"], "digest": digest, "payload_bytes": n, "payload": payload, "refers_to": page("warc-refers-to")}


class LoserTree:
    """K-way merge of sorted iterators: each new head plays only against the losers on its way up."""

    def __init__(self, runs: Iterable[Iterator[tuple]]):
        self.runs = [iter(r) for r in runs]
        k = len(self.runs)
        self.heads: list[tuple | None] = [next(r, None) for r in self.runs]
        self.tree = [-1] * max(k, 1)  # tree[0]: the winner; others: the loser at that node
        winners = {k + i: i for i in range(k)}
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            if self._before(b, a):
                a, b = b, a
            winners[node], self.tree[node] = a, b
        self.tree[0] = winners[1] if k else -1

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def __iter__(self) -> Iterator[tuple]:
        k = len(self.runs)
        while k and (head := self.heads[w := self.tree[0]]) is not None:
            yield head
            self.heads[w] = next(self.runs[w], None)
            node = (w + k) // 2
            while node:
                if self._before(self.tree[node], w):
                    w, self.tree[node] = self.tree[node], w
                node //= 2
            self.tree[0] = w


def _fs(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def _write(folder: str):
    """(page_id, url, html, seconds, refers_to, is_revisit) to archives; rows of the sorted run."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name, captures, f, at = f"part-{part:06d}.warc.gz", [], None, 0
        for batch in batches:
            for page_id, url, html, seconds, refers_to, again in zip(*(c.to_pylist() for c in batch.columns)):
                if f is None:
                    fs, path = _fs(folder)
                    fs.create_dir(path, recursive=True)
                    own = f"{path}/.{name}.{uuid.uuid4().hex}"
                    f = fs.open_output_stream(own)
                url = re.sub(r"[\r\n]+", " ", url)
                gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                raw = gz.compress(record(page_id, url, html.encode(), seconds, "revisit" if again else "response", refers_to)) + gz.flush()
                f.write(raw)
                captures.append((url_key(url), _stamp(seconds)[0], page_id, url, name, at, len(raw)))
                at += len(raw)
        if f is not None:
            f.close()
            fs.move(own, f"{path}/{name}")
            captures.sort(key=lambda c: (c[0], c[1], -1 if c[2] is None else c[2]))
            for i in range(0, len(captures), 10_000):
                cols = list(zip(*captures[i : i + 10_000]))
                kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols, kinds)], pa.array([part] * len(cols[0]), pa.int32()), pa.array(range(i, i + len(cols[0])), pa.int64())], ["url_key", "timestamp", "page_id", "url", "file", "offset", "length", "run", "seq"])

    return run


def _merge(batches):
    """The slices of all runs for each range (rows sorted by range, run and place) merged by a loser tree.

    One range is in memory, as Arrow columns; of each slice, the keys of ``AHEAD`` rows at a time.
    """
    import pyarrow as pa

    def slices(t, a: int, b: int):
        for i in range(a, b, AHEAD):
            part = t.slice(i, min(AHEAD, b - i))
            pages = (-1 if p is None else p for p in part.column("page_id").to_pylist())
            yield from zip(zip(part.column("url_key").to_pylist(), part.column("timestamp").to_pylist(), pages), range(i, b))

    def merged(held: list):
        t = pa.Table.from_batches(held).combine_chunks()
        run = t.column("run").to_numpy()
        starts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist()]
        tree = iter(LoserTree(slices(t, a, b) for a, b in zip(starts, [*starts[1:], len(run)])))
        thin = t.drop_columns(["run", "seq"])
        at = 0
        while order := [i for _, i in islice(tree, 10_000)]:
            out = thin.take(pa.array(order)).append_column("position", pa.array(range(at, at + len(order)), pa.int64()))
            at += len(order)
            yield from out.combine_chunks().to_batches()

    held: list = []
    last = None
    for b in batches:
        own = b.column(b.schema.get_field_index("range")).to_numpy()
        cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
        for a, z in zip(cuts, cuts[1:]):
            if a == z:
                continue
            if held and own[a] != last:
                yield from merged(held)
                held = []
            held.append(b.slice(a, z - a))
            last = own[a]
    if held:
        yield from merged(held)


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", seconds_col: str | None = None, min_revisit: int = 0) -> tuple[str, DataFrame]:
    """Write archives and merge their runs; returns the folder and the ordered index.

    Index: ``INDEX`` columns with ``range`` and ``position``, which together are the global order.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    html = F.coalesce(F.col(html_col), F.lit(""))
    seconds = F.col(seconds_col).cast("long") if seconds_col else F.lit(FIRST_CAPTURE) + F.coalesce(F.pmod(F.col(id_col).cast("long"), F.lit(10**9)), F.lit(0))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("about:blank")).alias("url"), html.alias("html"), seconds.alias("seconds"))
    # verdicts on thin rows (digests); the payloads are dealt out once at most, by page, so no hot digest gathers them
    thin = rows.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("n")).distinct()
    winners = thin.where(F.col("n") >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("winner"))
    again = thin.join(winners, "digest").where(F.col("page_id") < F.col("winner")).select("page_id", "digest", "winner")
    # a page id may repeat with other html, so the digest is part of the key; null ids are responses
    joined = rows.withColumn("digest", F.sha1("html")).join(again, ["page_id", "digest"], "left")
    # in a fixed order, so that a task that runs again leaves the same archive
    ready = joined.sortWithinPartitions("page_id", "digest", "url").select("page_id", "url", "html", "seconds", F.col("winner").alias("refers_to"), F.col("winner").isNotNull().alias("again"))
    runs = Stored(ready.mapInArrow(_write(folder), f"{INDEX}, run int, seq long"), "warc-runs").df
    return folder, merge_runs(runs)


def merge_runs(runs: DataFrame) -> DataFrame:
    """Locally sorted runs (``INDEX``, run, seq) merged into one order."""
    spark = runs.sparkSession
    total = runs.count()
    n = max(shuffle_partitions(spark), -(-total // RANGE_ROWS))  # a range is one merge in memory
    samples = max(SAMPLES, 4 * n)
    step = max(1, total // samples)
    sample = runs.where(F.pmod("seq", F.lit(step)) == step // 2).select("url_key", "timestamp", F.coalesce("page_id", F.lit(-1)).alias("p")).orderBy("url_key", "timestamp", "p")
    picked = [tuple(r) for r in sample.collect()]  # about ``samples``, and one for each run
    cuts = [picked[i * len(picked) // n] for i in range(1, n)] if picked else []
    ranged = runs.mapInArrow(_range_of(cuts), runs.schema.simpleString()[7:-1].replace(":", " ") + ", range int")
    slices = ranged.repartition(n, "range").sortWithinPartitions("range", "run", "seq")
    return Stored(slices.mapInArrow(_merge, f"{INDEX}, range int, position long"), "warc-index").df


def _range_of(cuts: list[tuple]):
    def run(batches):
        from bisect import bisect_right

        import pyarrow as pa

        for b in batches:
            keys = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())
            at = [bisect_right(cuts, (u, t, -1 if p is None else p)) for u, t, p in keys]
            yield b.append_column("range", pa.array(at, pa.int32()))

    return run


def _read(folder: str):
    """Records of rows in order of files and offsets: records that lie side by side are one read, up to ``READ_BYTES``."""

    def run(batches):
        import pyarrow as pa

        fs, path = _fs(folder)
        f, name = None, None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            files, offsets, lengths = (b.column(i).to_pylist() for i in range(3))
            rows, i = [], 0
            while i < len(files):
                if files[i] != name:
                    if f:
                        f.close()
                    name, f = files[i], fs.open_input_file(f"{path}/{files[i]}")
                k, size = i + 1, lengths[i]
                while k < len(files) and files[k] == name and offsets[k] == offsets[i] + size and size + lengths[k] <= READ_BYTES:
                    size, k = size + lengths[k], k + 1
                raw = f.read_at(size, offsets[i])
                for at, n in zip(offsets[i:k], lengths[i:k]):
                    r = parse_record(zlib.decompress(raw[at - offsets[i] : at - offsets[i] + n], 31))
                    rows.append((r["page_id"], r["payload_bytes"], r["digest"], r["type"], r["refers_to"]))
                i = k
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols, kinds)], *[b.column(i) for i in range(3, 7)]], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp", "range", "position"])
        if f:
            f.close()

    return run


def read_archives(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """A row for each index row, from its record in the archives.

    The index is in order of URLs, so its thin rows are dealt out by file and stretches of ``SPAN_BYTES`` first: a task reads a
    stretch from its beginning to its end, and no file is opened for a single record.
    """
    cols = index.select("file", "offset", "length", "url_key", "timestamp", "range", "position")
    dealt = cols.repartition("file", F.floor(F.col("offset") / SPAN_BYTES)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_read(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, timestamp string, range int, position long")
