"""Removal of byte strings repeated across documents, by distributed prefix doubling.

A position's rank at length h is a 64-bit name of the h bytes that start there; names double inside a document (name of 2h =
pair of names at p and p + h), so no join fetches the partner's rank. Spark sorts (name, document) rows at growing lengths,
and positions whose name is unique drop out, until the threshold length is reached:

1. length 22, at sampled positions. Each 50-byte window is represented by the smallest 22-byte name inside it (its
   anchor); equal windows have equal anchors, so windows whose anchor is unique are unique and drop out without loss. An anchor whose
   whole run of windows equals that of a smaller document settles all of them at once.
2. length 50, at every window of the anchors that are left.

Chunks of documents settle repeats among themselves before the shuffle, so hot passages reach a sort once per chunk. Reducers stream
over sorted rows with constant state besides the open group's distinct contexts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored

LENGTH = 50
#: Greatest length: what the bits of a span hold.
MAX_LENGTH = 1 << 22
#: Bytes of text that are named together; longer texts are named in pieces that overlap.
_CHUNK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xBF58476D1CE4E5B9)
_S1, _S2 = np.uint64(29), np.uint64(32)
_BYTES = np.random.RandomState(20).randint(0, 2**63 - 1, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
# span: first window (40 bits) | windows - 1 (23) | settled (1)
_AT, _MORE = np.uint64(24), np.uint64(1)
_MORE_MASK = np.uint64((1 << 23) - 1)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of a pair of names."""
    x = a * _ODD
    x += b
    x ^= x >> _S1
    x *= _ODD2
    x ^= x >> _S2
    return x


class _Names:
    """Names of the strings of a given length at all positions of a buffer, by doubling."""

    def __init__(self, buf: np.ndarray, longest: int) -> None:
        self.n, self.by = len(buf), {1: _BYTES[buf]}
        size = 1
        while 2 * size <= longest:
            h = self.by[size]
            self.by[2 * size] = _pair(h[: max(0, len(h) - size)], h[size:])
            size *= 2

    def of(self, length: int) -> np.ndarray:
        out, at = None, 0
        for size in sorted(self.by, reverse=True):
            if length - at >= size:
                part = self.by[size][at:]
                n = len(part) if out is None else min(len(out), len(part))
                out = part if out is None else _pair(out[:n], part[:n])
                at += size
        return out[: max(0, self.n - length + 1)]


def _anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest name in each run of width names."""
    value, at, size = grams, np.arange(len(grams), dtype=np.int32), 1

    def join(shift: int) -> None:
        nonlocal value, at
        m = max(0, len(value) - shift)
        right = value[shift:] < value[:m]
        value, at = np.where(right, value[shift:], value[:m]), np.where(right, at[shift:], at[:m])

    while 2 * size <= width:
        join(size)
        size *= 2
    if width > size:
        join(width - size)
    return at


class _Chunk:
    """Pieces of texts in one buffer: for each piece its row, where it begins in its text and in the buffer, and how many windows start in it."""

    def __init__(self, texts: list[bytes], pieces: list[tuple[int, int, int]], length: int) -> None:
        own = [texts[i][base : base + n + length - 1] for i, base, n in pieces]
        self.buf = np.frombuffer(b"".join(own), np.uint8)
        self.start = np.cumsum([0, *map(len, own)])
        self.row, self.base, self.n = (np.array(c, np.int64) for c in zip(*pieces, strict=True))


def _chunks(texts: list[bytes], length: int, chunk: int) -> Iterator[_Chunk]:
    """Chunks of all texts of at least length bytes."""
    pieces: list[tuple[int, int, int]] = []
    size = 0
    for i, t in enumerate(texts):
        for base in range(0, len(t) - length + 1, chunk):
            n = min(chunk, len(t) - length + 1 - base)
            pieces.append((i, base, n))
            size += n + length - 1
            if size >= chunk:
                yield _Chunk(texts, pieces, length)
                pieces, size = [], 0
    if pieces:
        yield _Chunk(texts, pieces, length)


def _settle(key: np.ndarray, doc: np.ndarray, span: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Mark rows whose key a smaller document of the chunk has; their group (spread) is scattered."""
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    head = np.maximum.accumulate(np.where(np.concatenate([[True], k[1:] != k[:-1]]), np.arange(len(k)), 0))
    done = order[d > d[head]]
    span[done] |= _MORE
    spread = spread.copy()
    spread[done] = _pair(spread[done], span[done] ^ doc[done].view(np.uint64))
    return spread


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns.values()], names=list(columns))


def _tags(texts: list[bytes]) -> np.ndarray:
    """Spark's xxhash64 of each text: rows of one doc_id are told apart by it, equal rows share their outcome."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(t, 42) for t in texts], np.uint64)


def _binary(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _emit_anchors(batches: Iterator[pa.RecordBatch], length: int, chunk: int = _CHUNK) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (k, c, doc_id, tag, span): anchor name, name of its whole run of windows."""
    gram = max(1, length * 4 // 9)
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), _binary(batch.column(1))
        tags = _tags(texts)
        for c in _chunks(texts, length, chunk):
            names = _Names(c.buf, length)
            grams, windows = names.of(gram), names.of(length)
            at = _anchors(grams, length - gram + 1)
            of_byte = np.repeat(np.arange(len(c.row), dtype=np.int32), np.diff(c.start))
            inside = np.flatnonzero(of_byte[: len(windows)] == of_byte[length - 1 :])
            own = at[inside]
            first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (inside[1:] != inside[:-1] + 1)]))
            lo, hi = inside[first], inside[np.append(first[1:] - 1, len(inside) - 1)]
            piece = of_byte[lo]
            context = _pair(_pair(windows[lo], windows[hi]), (hi - lo).astype(np.uint64))
            row = c.row[piece]
            doc = ids[row]
            span = (lo - c.start[piece] + c.base[piece]).astype(np.uint64) << _AT | (hi - lo).astype(np.uint64) << _MORE
            key = _settle(context, doc, span, grams[own[first]])
            yield _batch(k=key, c=context, doc_id=doc, tag=tags[row], span=span)


def _reduce_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (k, c, doc_id) -> (doc_id, tag, span): settled ones, and those whose windows must be compared.

    Rows of an unfinished group are held until it has several contexts and several documents, so a single context's smallest document
    or a single document's contexts at most. From then on its rows pass through, and only the last context's first row is held.
    """
    held, passes = [np.empty(0, np.int64) for _ in range(5)], False

    def judged(rows: list[np.ndarray], is_open: bool) -> tuple[pa.RecordBatch | None, list[np.ndarray], bool]:
        k, c, d, t, s = rows
        new_k = np.concatenate([[True], k[1:] != k[:-1]])
        new_c = new_k | np.concatenate([[True], c[1:] != c[:-1]])
        head = np.maximum.accumulate(np.where(new_c, np.arange(len(k)), 0))
        done = (d > d[head]) | (s & 1 == 1)
        group = np.cumsum(new_k) - 1
        starts = np.flatnonzero(new_k)
        many = (np.add.reduceat(new_c.astype(np.int64), starts) > 1) & (np.maximum.reduceat(d, starts) > np.minimum.reduceat(d, starts))
        many[0] |= passes
        waits = (group == group[-1]) & is_open & ~many[-1]
        out = done | (many[group] & ~waits)
        out[0] &= not passes  # the one row held of a group that passes is out already
        spans = np.where(done, s | 1, s)[out]
        keep = head[-1:] if many[-1] else np.flatnonzero(waits & ~done)
        return (_batch(doc_id=d[out], tag=t[out], span=spans) if out.any() else None), [x[keep] for x in rows], bool(many[-1])

    for batch in batches:
        if batch.num_rows:
            found, held, passes = judged([np.concatenate([a, batch.column(i).to_numpy()]) for i, a in enumerate(held)], True)
            if found:
                yield found
    if len(held[0]):
        found, _, _ = judged(held, False)
        if found:
            yield found


def _emit_windows(batches: Iterator[pa.RecordBatch], length: int, chunk: int = _CHUNK) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) -> (k, doc_id, tag, span): the name of every window that is not settled."""
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), _binary(batch.column(1))
        lists, tags = batch.column(2), _tags(texts)
        places = []
        for i in range(len(texts)):
            s = np.array(lists[i].values.to_numpy(zero_copy_only=False)).view(np.uint64)
            s = s[s & _MORE == 0]
            more = (s >> _MORE & _MORE_MASK).astype(np.int64) + 1
            places.append(np.sort(np.repeat((s >> _AT).astype(np.int64) - np.cumsum(more) + more, more) + np.arange(more.sum())))
        for c in _chunks(texts, length, chunk):
            windows = _Names(c.buf, length).of(length)
            at, row = [], []
            for j, (i, base, n) in enumerate(zip(c.row, c.base, c.n, strict=True)):
                p = places[i][np.searchsorted(places[i], base) : np.searchsorted(places[i], base + n)]
                at.append(p)
                row.append(np.full(len(p), j))
            p, r = np.concatenate(at), np.concatenate(row)
            if not len(p):
                continue
            name, doc = windows[c.start[r] + p - c.base[r]], ids[c.row[r]]
            span = p.astype(np.uint64) << _AT
            yield _batch(k=_settle(name, doc, span, name), doc_id=doc, tag=tags[c.row[r]], span=span)


def _reduce_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (k, doc_id) -> (doc_id, tag, span) of windows that a smaller document has."""
    key, least = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        k, d, t, s = (batch.column(i).to_numpy() for i in range(4))
        head = np.maximum.accumulate(np.where(np.concatenate([[True], k[1:] != k[:-1]]), np.arange(len(k)), 0))
        smallest = d[head]
        if key is not None and k[0] == key:
            smallest[k == key] = least
        done = (d > smallest) | (s & 1 == 1)
        key, least = k[-1], smallest[-1]
        if done.any():
            yield _batch(doc_id=d[done], tag=t[done], span=s[done] | 1)


def _union(spans: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs (first byte, byte after) that the windows of spans cover."""
    if not len(spans):
        return []
    lo = (spans >> _AT).astype(np.int64)
    hi = lo + (spans >> _MORE & _MORE_MASK).astype(np.int64) + length
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    return list(zip(lo[new].tolist(), hi[np.append(new[1:] - 1, len(hi) - 1)].tolist(), strict=True))


def _remove(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, out = _binary(batch.column(1)), []
        for i, text in enumerate(texts):
            found = [np.array(c[i].values.to_numpy(zero_copy_only=False)).view(np.uint64) for c in (batch.column(2), batch.column(3)) if c[i].is_valid]
            runs = _union(np.concatenate([s[s & _MORE == 1] for s in found]), length) if found else []
            edges = [0, *(x for run in runs for x in run), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if runs else text
            out.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*out, strict=True)) or [()] * 5
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", chunk: int = _CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): one row per row of docs.

    Every byte is removed that a string of `length` bytes covers which also starts in a document with a smaller doc_id; strings are
    judged on the input. kept holds the remaining bytes. Null texts count as empty and texts under the length lose nothing;
    repeats inside one document, and rows of one doc_id, equal or not, lose nothing to each other; rows without doc_id neither lose bytes nor
    take any; an empty table gives an empty result. Texts of any length are named in pieces of chunk bytes. Other columns are ignored. length is 1 to MAX_LENGTH.
    """
    if not 1 <= length <= MAX_LENGTH:
        raise ValueError(f"length must be from 1 to {MAX_LENGTH}")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    able = source.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    per_text = lambda df: df.groupBy("doc_id", "tag").agg(F.collect_list("span").alias("spans"))

    anchors = able.mapInArrow(lambda it: _emit_anchors(it, length, chunk), "k long, c long, doc_id long, tag long, span long")
    by_anchor = anchors.repartition("k").sortWithinPartitions("k", "c", "doc_id")
    settled = stored(per_text(by_anchor.mapInArrow(_reduce_anchors, "doc_id long, tag long, span long")))

    tag = F.xxhash64("text")
    unsettled = settled.where(F.exists("spans", lambda s: s.bitwiseAND(F.lit(1)) == 0))
    left = able.withColumn("tag", tag).join(unsettled, ["doc_id", "tag"]).select("doc_id", "text", "spans")
    windows = left.mapInArrow(lambda it: _emit_windows(it, length, chunk), "k long, doc_id long, tag long, span long")
    by_window = windows.repartition("k").sortWithinPartitions("k", "doc_id")
    compared = stored(per_text(by_window.mapInArrow(_reduce_windows, "doc_id long, tag long, span long")).withColumnRenamed("spans", "more"))

    joined = source.withColumn("tag", tag).join(settled, ["doc_id", "tag"], "left").join(compared, ["doc_id", "tag"], "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return joined.select("doc_id", "text", "spans", "more").mapInArrow(lambda it: _remove(it, length), schema)
