"""Which keys of a document also occur in another document: one packed shuffle.

A document is a set of 56-bit keys (hashed shingles, hashed anchors). A plain row per key would cost
four times the key, so each task sorts the keys of a stretch of documents and ships, per key range,
one packed row: keys as compressed steps, the owner of each as a short index. A key held by ``HOT`` or more
documents of a stretch is shared and common whatever the rest of the corpus says: it is sent once
per stretch without owners, so a key that a third of all documents hold costs each stretch one entry.
A key that ``MANY`` documents of the whole corpus hold is common as well, however thinly it is spread.

Documents of a single key, which one clash of two keys would make equal, carry a second hash of what the key stands for.

``shared_keys`` returns a row per document: its number of keys and its shared keys in a global order,
rare first: by the number of documents that hold the key, common keys last
(from place ``n_rare`` on), ties by key. Keys that no other document holds come before all of them and are not returned.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.bytehash import runs

HOT = 8
MANY = 1000
BITS = 56
#: Keys of one stretch, text of one chunk and text for one key range, at most (a single longer document excepted).
STRETCH_KEYS = 400_000
CHUNK_BYTES = 500_000
RANGE_BYTES = 8_000_000
COMMON = np.uint32(0xFFFFFFFF)

#: Takes UTF-8 texts, returns (keys, document index of each), grouped by document, no key twice in one.
Keyer = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
#: Takes the text of a document with a single key, returns a second hash of it.
Checker = Callable[[bytes], int]


def give_back() -> None:
    """Returns freed memory to the system: workers live on between stages, beside each other and the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def pack(keys: np.ndarray) -> bytes:
    """Ascending keys as seven byte planes of their steps."""
    steps = np.diff(keys.astype("<u8"), prepend=np.uint64(0)) if len(keys) else keys.astype("<u8")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, 6::-1].T).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, dtype=np.uint8).reshape(7, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, 6::-1] = planes.T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def squeeze(values: np.ndarray | bytes) -> bytes:
    """Numbers as compressed byte planes; bytes as they are, compressed."""
    raw = values
    if not isinstance(values, bytes):
        raw = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes() if len(values) else b""
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unsqueeze(blob: bytes, dtype: str | None = None):
    raw = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    if dtype is None:
        return raw
    kind = np.dtype(dtype)
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """``counts`` consecutive values to each entry of a binary column."""
    offsets = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


STAGE = pa.schema([("slot", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("at", pa.binary()), ("docs", pa.binary()), ("second", pa.int64())])
ANSWER = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("df", pa.binary()), ("second", pa.int64())])


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Documents with an id, in chunks of bounded text."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for a in range(0, batch.num_rows, 128):
            part = batch.slice(a, 128)
            for doc_id, raw in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if doc_id is None:
                    continue
                ids.append(doc_id)
                texts.append(raw or b"")
                size += len(raw or b"")
                if size >= CHUNK_BYTES or len(ids) >= 4000:
                    yield np.array(ids, dtype=np.int64), texts
                    ids, texts, size = [], [], 0
    if ids:
        yield np.array(ids, dtype=np.int64), texts


def _stretch(ids: np.ndarray, keys: np.ndarray, owner: np.ndarray, second: np.ndarray, shift: int) -> pa.RecordBatch:
    """Packed rows of one stretch: a row per document with its common keys, a row per key range with the rest."""
    order = np.argsort(keys, kind="stable")
    sorted_keys, sorted_owner = keys[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    times = np.diff(np.concatenate([first, [len(keys)]]))
    hot = np.repeat(times >= HOT, times)
    common = _documents(ids, np.bincount(owner, minlength=len(ids)), sorted_owner[hot], sorted_keys[hot], second, shift)
    rows: dict[str, list] = {name: [] for name in STAGE.names}

    send = np.concatenate([np.flatnonzero(~hot), first[times >= HOT]])
    send.sort()
    owners = np.where(hot[send], len(ids), sorted_owner[send]).astype(np.uint16)
    sent = sorted_keys[send]
    ranges = sent >> np.uint64(shift)
    for a, b in runs(ranges):
        used, at = np.unique(owners[a:b], return_inverse=True)
        docs = ids[used[used < len(ids)]]
        for name, v in zip(STAGE.names, (int(ranges[a]), None, None, squeeze(pack(sent[a:b])), squeeze(at.astype("<u2")), squeeze(docs), None), strict=True):
            rows[name].append(v)
    return pa.Table.from_batches([common, pa.RecordBatch.from_pydict(rows, schema=STAGE)]).combine_chunks().to_batches()[0]


def _documents(ids: np.ndarray, n: np.ndarray, owner: np.ndarray, keys: np.ndarray, second: np.ndarray, shift: int) -> pa.RecordBatch:
    """A row per document with its own common keys."""
    order = np.argsort(owner, kind="stable")
    blobs = binary(keys[order], np.bincount(owner, minlength=len(ids)))
    none = pa.nulls(len(ids), pa.binary())
    slots = pa.array(ids % (1 << (BITS - shift)))
    return pa.RecordBatch.from_arrays([slots, pa.array(ids), pa.array(n.astype(np.int64)), blobs, none, none, pa.array(second)], schema=STAGE)


def _emit(keyer: Keyer, checker: Checker | None, shift: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, owner, second, count, docs = [], [], [], [], 0, 0
        for own, texts in chunks(batches):
            k, o = keyer(texts)
            check = np.zeros(len(own), dtype=np.int64)
            for d in np.flatnonzero(np.bincount(o, minlength=len(own)) == 1).tolist() if checker else ():
                check[d] = checker(texts[d])
            second.append(check)
            ids.append(own)
            keys.append(k)
            owner.append(o + docs)
            docs += len(own)
            count += len(k)
            if count >= STRETCH_KEYS or docs >= 60_000:
                yield _stretch(np.concatenate(ids), np.concatenate(keys), np.concatenate(owner), np.concatenate(second), shift)
                ids, keys, owner, second, count, docs = [], [], [], [], 0, 0
        if ids:
            yield _stretch(np.concatenate(ids), np.concatenate(keys), np.concatenate(owner), np.concatenate(second), shift)
        ids, keys, owner = [], [], []
        give_back()

    return emit


def _resolve(group: pa.Table) -> pa.Table:
    """All packed rows of one slot: documents pass with their common keys; keys held twice go back to their owners."""
    plain = group.filter(pc.is_null(group["at"])).select(["doc_id", "n", "keys", "second"]).combine_chunks()
    sizes = pc.binary_length(plain["keys"]).to_numpy(zero_copy_only=False) // 8
    parts = [pa.Table.from_arrays([*plain.columns[:3], binary(np.full(sizes.sum(), COMMON, dtype="<u4"), sizes), plain["second"]], schema=ANSWER)]
    keys, owners, owned = [], [], []
    packed = group.filter(pc.is_valid(group["at"]))
    for blob, at, docs in zip(*(packed.column(c).to_pylist() for c in ("keys", "at", "docs")), strict=True):
        ids, index = unsqueeze(docs, "<i8"), unsqueeze(at, "<u2")
        keys.append(unpack(unsqueeze(blob)))
        owned.append(index < len(ids))
        owners.append(np.concatenate([ids, [0]])[index])
    if keys:
        k, o, w = np.concatenate(keys), np.concatenate(owners), np.concatenate(owned)
        order = np.argsort(k, kind="stable")
        k, o, w = k[order], o[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        times = np.diff(np.concatenate([first, [len(k)]]))
        common = np.logical_or.reduceat(~w, first)
        df = np.repeat(np.where(common | (times >= MANY), COMMON, times).astype(np.uint32), times)
        back = w & (df > 1)
        k, o, df = k[back], o[back], df[back]
        order = np.argsort(o, kind="stable")
        k, o, df = k[order], o[order], df[order]
        if len(o):
            cuts = np.array(runs(o))
            counts = cuts[:, 1] - cuts[:, 0]
            ids = pa.array(o[cuts[:, 0]])
            parts.append(pa.Table.from_arrays([ids, pa.nulls(len(ids), pa.int64()), binary(k.astype("<u8"), counts), binary(df.astype("<u4"), counts), pa.nulls(len(ids), pa.int64())], schema=ANSWER))
    keys = owners = owned = None
    give_back()
    return pa.concat_tables(parts).combine_chunks()


def _numbers(lists: pa.ListArray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of lists of binaries, and the row of each."""
    blobs = lists.flatten()
    sizes = pc.binary_length(blobs).to_numpy(zero_copy_only=False) // np.dtype(dtype).itemsize
    rows = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return np.frombuffer(b"".join(blobs.to_pylist()), dtype=dtype), np.repeat(rows, sizes)


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, whole.num_rows, 1000):
            batch = whole.slice(a, 1000)
            keys, row = _numbers(batch.column("keys"), "<u8")
            df, _ = _numbers(batch.column("df"), "<u4")
            order = np.lexsort((keys, df, row))
            keys, row, df = keys[order], row[order], df[order]
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])]) if len(keys) else np.zeros(0, dtype=bool)
            # rows of one document share keys: each counts once
            n = batch.column("n").to_numpy(zero_copy_only=False) - np.bincount(row[~new], minlength=batch.num_rows)
            counts = np.bincount(row[new], minlength=batch.num_rows)
            rare = np.bincount(row[new & (df < COMMON)], minlength=batch.num_rows)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(keys[new].astype(np.int64)))
            columns = [batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(rare.astype(np.int64)), lists, batch.column("second")]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "n_rare", "keys", "second"])
    give_back()


def key_ranges(docs: DataFrame) -> int:
    """Bits to shift keys by, so that a range holds the keys of about RANGE_BYTES of text; 64 ranges at least."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return BITS - max(6, int(np.ceil(np.log2(max(1, size / RANGE_BYTES)))))


def shared_keys(docs: DataFrame, keyer: Keyer, shift: int | None = None, checker: Checker | None = None) -> DataFrame:
    """doc_id, n (its keys), n_rare, keys (those shared, in global order), second of every document (doc_id, text) with an id."""
    packed = docs.select("doc_id", "text").mapInArrow(_emit(keyer, checker, key_ranges(docs) if shift is None else shift), "slot long, doc_id long, n long, keys binary, at binary, docs binary, second long")
    # documents and key ranges meet in the same exchange; a slot of either kind is small
    answers = packed.groupBy("slot").applyInArrow(_resolve, "doc_id long, n long, keys binary, df binary, second long")
    per_doc = answers.groupBy("doc_id").agg(F.sum("n").alias("n"), F.collect_list("keys").alias("keys"), F.collect_list("df").alias("df"), F.max("second").alias("second"))
    return per_doc.mapInArrow(_ordered, "doc_id long, n long, n_rare long, keys array<long>, second long")
