"""Removal of bytes that lie in a string of `LEAST` bytes which also starts elsewhere in the corpus, by suffix arrays.

Where equal strings meet. Every window of `LEAST` bytes has an anchor: the least hash among its `GRAM`-byte grams, the
leftmost where equal. Equal windows have equal anchors at the same place, so that they meet under the anchor's hash; each
window start belongs to one anchor. An anchor with its run of window starts is a region (the bytes of those windows).
Anchors that occur once are done with. Regions of an anchor with the same bytes form a class (known by two hashes of different
kinds, the anchor's and one of the region's bytes); one region stands for it, with the number of its members.

How they are compared. The classes of an anchor go to one task, which sorts the suffixes of many anchors' regions at once: bytes
are grouped to eight-byte symbols aligned at the anchor, `suffix_array` orders them by grouping, and neighbours' common
prefixes cut the order into runs that share the wanted length. A window that starts between two symbols is judged in the
run of the next symbol, by its few bytes before it. Windows of a run repeat if they come from two regions, two places or a
class of several. What a class's windows are found to be holds for all of its members.

An anchor with more than `HOT` classes (a passage of very many documents, where it meets their own words) is too much for one
task: of its windows those whose first or last gram no other has are done with, the others are grouped by their bytes over the
cluster.

Texts are UTF-8 bytes; null is empty. Matches don't cross documents; overlapping matches in one document count. A document
is known by its key and a hash of its text, so that repeated keys with other texts stay apart, and repeated rows are each
other's copies. Null keys are allowed. An empty table gives none. Extra columns don't pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoplate.llm.common import dropped, few, looked_up, slices, written
from chronoplate.llm.minhash import mixed
from chronoplate.llm.suffix_array import suffix_array

LEAST, GRAM = 200, 32
HOT = 5_000
#: Window starts handled at once; positions in a chunk take this many low bits of a packed minimum.
CHUNK_BITS = 18
#: Rows of two or three numbers that may be broadcast (some 50 MB); more are joined by a shuffle.
BROADCAST_ROWS = 1_500_000
#: Bytes of regions that one suffix array takes, and so the memory of a task.
SORTED_BYTES = 1_000_000

_U = np.uint64


def _consts() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random odd-sized values of the bytes, and powers of the base and of its inverse modulo 2^64, for a chunk."""
    size = (1 << CHUNK_BITS) + 1
    values = mixed(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
    base = 0x9E3779B97F4A7C15 | 5
    up, down = np.full((2, size), base, _U)
    down[:] = pow(base, -1, 1 << 64)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return values, up, down


_CONSTS: list = []


def consts():
    if not _CONSTS:
        _CONSTS.extend(_consts())
    return _CONSTS


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of w values: block-wise running minima from both sides."""
    n = len(v)
    padded = np.full(-(-n // w) * w, np.iinfo(v.dtype).max, v.dtype)
    padded[:n] = v
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def regions(data: np.ndarray, ends: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """Regions of documents that are joined in `data` and end at `ends`: arrays (document, first window, windows, anchor - first window, gram hash, region hash). Positions count from the document's start."""
    values, up, down = consts()
    starts = np.concatenate([[0], ends[:-1]])
    found: list[tuple[np.ndarray, ...]] = []
    step = (1 << CHUNK_BITS) - least - 1
    for lo in range(0, max(0, len(data) - least + 1), step):
        part = data[lo : lo + step + least - 1]
        n = len(part)
        total = np.zeros(n + 1, _U)
        np.cumsum(values[part] * up[:n], out=total[1:])
        grams = mixed((total[gram:] - total[:-gram]) * down[: n - gram + 1])
        packed = (grams >> _U(CHUNK_BITS) << _U(CHUNK_BITS)) | np.arange(len(grams), dtype=_U)
        anchor = (sliding_min(packed, least - gram + 1) & _U((1 << CHUNK_BITS) - 1)).astype(np.int64)
        p = np.arange(len(anchor))
        doc = np.searchsorted(ends, lo + p, side="right")
        p = p[lo + p + least <= ends[doc]]  # windows inside one document
        if not len(p):
            continue
        anchor, doc = anchor[p], doc[p]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(doc) != 0)]))
        first, a, doc = p[new], anchor[new], doc[new]
        count = np.diff(np.append(new, len(p)))
        last = first + count - 1 + least
        held = memoryview(part)
        whole = np.fromiter((xxhash.xxh3_64_intdigest(held[x:y], seed=z) for x, y, z in zip(first.tolist(), last.tolist(), (a - first).tolist(), strict=True)), _U, len(first))
        found.append((doc, lo + first - starts[doc], count, a - first, grams[a], whole))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _joined(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column joined, and where each row's end."""
    values = [x or b"" for x in batch.column(column).to_pylist()]
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum([len(x) for x in values], dtype=np.int64)


def _documents(docs: DataFrame, key: str, text: str, carry: tuple[str, ...]) -> DataFrame:
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    return docs.select(docs[key].alias("id"), F.xxhash64(t).alias("th"), F.encode(t, "UTF-8").alias("data"), F.struct(F.lit(0).alias("_"), *(docs[c].alias(c) for c in carry)).alias("rest"))


def _id(df: DataFrame) -> str:
    return df.schema["id"].dataType.simpleString()


def all_regions(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """(id, th, anchor, whole, p0, n, off) of every region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "data", 4_000_000) if batch.num_rows else ():
                doc, p0, n, off, anchor, whole = regions(*_joined(part, 2), least, gram)
                rows = pa.array(doc.astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(p0.astype(np.int32)), pa.array(n.astype(np.int16)), pa.array(off.astype(np.int16))], names=["id", "th", "anchor", "whole", "p0", "n", "off"])

    return docs.select("id", "th", "data").filter(F.octet_length("data") >= least).mapInArrow(run, f"id {_id(docs)}, th bigint, anchor bigint, whole bigint, p0 int, n smallint, off smallint")


def with_bytes(wanted: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """(anchor, whole, times, off, n, bytes) of wanted regions, cut from the texts."""
    lists = written(wanted.groupBy(F.col("id").alias("wid"), F.col("th").alias("wth")).agg(F.collect_list(F.struct("p0", "n", "off", "anchor", "whole", "times")).alias("list")), "wanted")
    # The same shuffle of the texts as that of the last join, so that Spark does it once.
    both = docs.join(lists, docs["id"].eqNullSafe(F.col("wid")) & (docs["th"] == F.col("wth"))).select("data", "list")
    cut = both.select("data", F.explode("list").alias("r"))
    piece = F.substring(F.col("data"), F.col("r.p0") + 1, F.col("r.n") + (least - 1))
    # Repeated rows of a document give a region again.
    return cut.select("r.anchor", "r.whole", "r.times", "r.off", "r.n", piece.alias("bytes"))


def repeated_windows(parts: list[bytes], counts: np.ndarray, offs: np.ndarray, least: int, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(region, window) of every window of the regions that another window among them equals, or that stands for several, by one suffix array."""
    lead = (offs % 8).astype(np.int64)  # bytes before the first aligned symbol
    lens = np.array([len(x) for x in parts], np.int64)
    blocks = (lens - lead + 7) // 8
    first = np.cumsum(blocks + 1) - blocks  # each region follows a separator
    # One buffer, region r's aligned symbols at 8 * first[r]; its lead in the separator's eight bytes.
    size = int(blocks.sum()) + len(parts)
    buffer = bytearray(8 * size + least)
    for x, f, a in zip(parts, (8 * first).tolist(), lead.tolist(), strict=True):
        buffer[f - a : f - a + len(x)] = x
    data = np.frombuffer(buffer, np.uint8)
    words = data[: 8 * size].view(">u8").astype(_U)
    full = np.full(size, 8, np.int64)
    full[first + blocks - 1] = lens - lead - 8 * (blocks - 1)
    values = np.unique(words)
    symbols = (np.searchsorted(values, words) * 9 + full + 1).tolist()
    for f in (first - 1).tolist():
        symbols[f] = 0
    order = np.array(suffix_array(symbols), np.int64)
    owner = np.repeat(np.arange(len(parts)), blocks + 1)
    local = np.arange(size) - first[owner]
    # Symbols that start a window, or follow one's start by less than eight bytes.
    useful = (local >= 0) & (8 * local + lead[owner] - 7 < counts[owner])
    order = order[useful[order]]
    at = 8 * order
    common = np.zeros(len(order), np.int64)  # with the suffix before, up to `least`
    for lo in range(1, len(order), 20_000):
        hi = min(lo + 20_000, len(order))
        rows = data[at[lo - 1 : hi, None] + np.arange(least)]
        differ = rows[1:] != rows[:-1]
        common[lo:hi] = np.where(differ.any(axis=1), differ.argmax(axis=1), least)
    before = np.where(order > 0, words[order - 1], 0)
    out_r, out_w = [], []
    for s in range(8):
        run = np.cumsum(common < least - s)
        window = 8 * local[order] + lead[owner[order]] - s
        ok = np.flatnonzero((window >= 0) & (window < counts[owner[order]]))
        if not len(ok):
            continue
        run, tail = run[ok], before[ok] & _U((1 << (8 * s)) - 1)
        by = np.lexsort((tail, run))
        same = np.concatenate([[False], (np.diff(run[by]) == 0) & (tail[by][1:] == tail[by][:-1])])
        same[:-1] |= same[1:]
        hit = ok[by[same | (times[owner[order[ok[by]]]] > 1)]]
        out_r.append(owner[order[hit]])
        out_w.append(window[hit])
    return (np.concatenate(out_r), np.concatenate(out_w)) if out_r else (np.empty(0, np.int64), np.empty(0, np.int64))


def _runs(region: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as maximal runs (region, first, last)."""
    by = np.lexsort((window, region))
    region, window = region[by], window[by]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(region) != 0) | (np.diff(window) != 1)]))
    return region[new], window[new], window[np.append(new[1:], len(region)) - 1]


def by_suffix_array(cut: DataFrame, least: int, tasks: int) -> DataFrame:
    """Repeated windows (anchor, whole, s, e) of classes; those of an anchor meet in one task."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        anchors, wholes, times, off, n, parts = zip(*rows, strict=True)
        region, window = repeated_windows(list(parts), np.array(n, np.int64), np.array(off, np.int64), least, np.array(times, np.int64))
        last = window
        if len(region):
            region, window, last = _runs(region, window)
        rows = pa.array(region)
        return pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()).take(rows), pa.array(wholes, pa.int64()).take(rows), pa.array(window.astype(np.int32)), pa.array(last.astype(np.int32))], names=["anchor", "whole", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and row[:2] == rows[-1][:2]:
                    continue  # a document that is there twice
                if size >= SORTED_BYTES and row[0] != last:
                    yield settle(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[5])
                last = row[0]
        if rows:
            yield settle(rows)

    return cut.repartition(tasks, "anchor").sortWithinPartitions("anchor", "whole").mapInArrow(run, "anchor bigint, whole bigint, s int, e int")


def by_window_counts(cut: DataFrame, least: int, gram: int) -> DataFrame:
    """The same for anchors with very many classes: windows whose ends meet others are grouped by their bytes over the cluster."""
    cut = written(cut.dropDuplicates(["anchor", "whole"]), "hot")
    end = lambda at: F.substring("bytes", F.col("w") + 1 + at, F.lit(gram))
    places = cut.select("anchor", "whole", "times", "bytes", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("w"))
    ends = places.select("anchor", "whole", "times", "w", F.xxhash64(end(F.lit(0)), end(F.lit(least - gram))).alias("ends"))
    met = written(ends.groupBy("anchor", "ends").agg(F.sum("times").alias("all")).filter("all > 1").select("anchor", "ends"), "ends")
    left = looked_up(ends, met.withColumn("met", F.lit(True)), ["anchor", "ends"], F.xxhash64("whole", "w"), BROADCAST_ROWS).filter("met").select("anchor", "whole", "w")
    windows = written(left.groupBy("anchor", "whole").agg(F.collect_list("w").alias("ws")), "windows").join(cut, ["anchor", "whole"]).select("anchor", "whole", "times", "bytes", F.explode("ws").alias("w"))
    piece = F.substring("bytes", F.col("w") + 1, F.lit(least))
    windows = written(windows.select("anchor", "whole", "times", "w", piece.alias("piece")), "pieces")
    twice = windows.groupBy("anchor", "piece").agg(F.sum("times").alias("all")).filter("all > 1").select("anchor", "piece")
    found = looked_up(windows, written(twice, "twice").withColumn("found", F.lit(True)), ["anchor", "piece"], F.xxhash64("whole", "w")).filter("found")
    return found.select("anchor", "whole", F.col("w").alias("s"), F.col("w").alias("e"))


def repeats(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """(id, th, s, e): the windows that start from s to e repeat. `docs` has (id, th, data)."""
    spark = docs.sparkSession
    found = written(all_regions(docs, least, gram), "regions")
    shared = written(found.groupBy("anchor").agg(F.count("*").alias("seen")).filter("seen > 1").select("anchor"), "shared")
    met = written(found.join(few(shared, BROADCAST_ROWS), "anchor"), "met")
    dropped(found)
    # first() of several columns takes them from one row; any row of a class may stand for it.
    one = [F.first(c).alias(c) for c in ("id", "th", "p0", "n", "off")]
    classes = written(met.groupBy("anchor", "whole").agg(F.count("*").alias("times"), *one), "classes")
    hot = written(classes.groupBy("anchor").agg(F.count("*").alias("kinds")).filter(F.col("kinds") > HOT).select("anchor"), "hot_anchors")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    runs = by_suffix_array(with_bytes(classes.join(few(hot, BROADCAST_ROWS), "anchor", "left_anti"), docs, least), least, tasks)
    if not hot.isEmpty():
        runs = runs.unionByName(by_window_counts(with_bytes(classes.join(few(hot, BROADCAST_ROWS), "anchor", "left_semi"), docs, least), least, gram))
    runs = written(runs, "runs")
    dropped(classes)
    return met.join(few(runs, BROADCAST_ROWS), ["anchor", "whole"]).select("id", "th", (F.col("p0") + F.col("s")).alias("s"), (F.col("p0") + F.col("e")).alias("e"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, gram: int = GRAM, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """`key`, the columns `carry` of the row, `n_bytes`, `n_removed`, `n_spans` (maximal removed runs), `spans` array<struct<start, end>> and `kept` binary (the remaining bytes), a row for every row of `docs`.

    `least` is the length of a repeat in bytes, `gram` (at most `least`) that of an anchor. With `as_text`, `kept` is a string: a
    character of which a cut took some bytes is left out whole."""
    docs = _documents(docs, key, text, carry)
    # One shuffle by document serves the lists; as sets they are bounded by its text, however often a row is repeated.
    lists = repeats(docs, least, gram).groupBy(F.col("id").alias("wid"), F.col("th").alias("wth")).agg(F.collect_set(F.struct("s", "e")).alias("runs"))
    both = docs.join(lists, docs["id"].eqNullSafe(F.col("wid")) & (docs["th"] == F.col("wth")), "left").select("id", "data", "runs", "rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "data", 4_000_000) if batch.num_rows else ():
                rows = []
                for data, runs in zip(part.column(1).to_pylist(), part.column(2), strict=True):
                    spans: list[list[int]] = []
                    if runs.is_valid:
                        s, e = (runs.values.field(i).to_numpy() for i in (0, 1))
                        by = np.argsort(s, kind="stable")
                        s, e = s[by].astype(np.int64), np.maximum.accumulate(e[by].astype(np.int64)) + least
                        new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
                        spans = np.stack([s[new], e[np.append(new[1:], len(s)) - 1]], axis=1).tolist()
                    kept, at = [], 0
                    for a, b in spans:
                        kept.append(data[at:a])
                        at = b
                    left = b"".join([*kept, data[at:]])
                    rows.append((len(data), sum(b - a for a, b in spans), len(spans), [{"start": a, "end": b} for a, b in spans], left.decode("utf-8", "ignore") if as_text else left))
                n, removed, count, lists, kept = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), *(pa.array(x, pa.int64()) for x in (n, removed, count)), pa.array(lists, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string() if as_text else pa.binary())], names=["id", "rest", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    rest = docs.schema["rest"].dataType.simpleString()
    out = both.mapInArrow(run, f"id {_id(docs)}, rest {rest}, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start: bigint, end: bigint>>, kept {'string' if as_text else 'binary'}")
    return out.select(F.col("id").alias(key), *(F.col("rest")[c].alias(c) for c in carry), "n_bytes", "n_removed", "n_spans", "spans", "kept")
