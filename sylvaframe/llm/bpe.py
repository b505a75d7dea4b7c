"""Byte-level BPE: priority queue of merge ranks over a doubly linked list of symbols.

Encoding cuts a text at the special tokens and by the byte-level pre-tokenizer's pattern; each piece starts as a
linked list of byte symbols. A heap holds (rank, left position) of every adjacent pair that has a merge; entries
whose symbols were merged meanwhile are stale and skipped. Decoding concatenates the vocabulary's byte strings. Pieces repeat, so
each worker keeps the ids of pieces it has met, up to a fixed number of entries.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern of the public byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CACHE = 1 << 19
_CACHED_CHARS = 64


def byte_alphabet() -> dict[int, str]:
    """Byte -> printable character: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class BytePairCodec:
    """Encoder and decoder from a tokenizer file of the byte-level BPE kind."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        back = {c: b for b, c in alphabet.items()}
        self.byte_id = [vocab[alphabet[b]] for b in range(256)]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.strings: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.pieces = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece."""
        ids = [self.byte_id[b] for b in piece.encode("utf-8")]
        n = len(ids)
        if n < 2:
            return tuple(ids)
        merges, after, before = self.merges, [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:  # stale: one of the two has been merged since
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            h = before[i]
            if h >= 0 and (m := merges.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, ids[h], new, m[1]))
        return tuple(x for x in ids if x >= 0)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts have none. Special tokens inside a text become their own ids."""
        if not text:
            return []
        out: list[int] = []
        known, merge = self.known, self.merge
        for part in self.cut(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            for piece in self.pieces(part):
                ids = known.get(piece)
                if ids is None:
                    ids = merge(piece)
                    if len(piece) <= _CACHED_CHARS:
                        if len(known) >= _CACHE:
                            known.clear()
                        known[piece] = ids
                out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """Concatenated vocabulary strings as UTF-8; broken sequences become U+FFFD."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> BytePairCodec:
    return BytePairCodec(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256), with_ids=False leaves ids out.

    One row per row of docs, whole texts; null texts count as empty (no tokens, hashes of the empty string); other
    columns are ignored. path is a tokenizer file that every executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [own.encode(t) for t in part.column(1).to_pylist()]
                packed = [np.array(r, "<u4") for r in rows]
                columns = [
                    part.column(0),
                    pa.array([len(r) for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                    pa.array([hashlib.sha256(own.decode(r).encode("utf-8")).hexdigest() for r in rows], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array([p.astype(np.int32) for p in packed], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from arrays of ids; a null array gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(r or []) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    source = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return source.mapInArrow(run, "doc_id long, text string")
