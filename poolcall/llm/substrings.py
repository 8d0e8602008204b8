"""Substring dedup by difference-cover anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from poolcall.llm.common import arrow_schema, mixed, partitions_of, record_batch, slices, window_hashes, word_hashes, words_of

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)  # each residue modulo 13 is a difference of two of these
BUCKETS_PER_PARTITION = 4

ENTRY = "bucket int, kind int, hashes binary, docs binary"
OPEN, SETTLED, KNOWN = 0, 1, 2
ENTRY_ROWS = 2_500  # documents whose hashes are combined before they are sent


def check_cover(window: int, period: int, cover: tuple) -> int:
    """Words in an anchor: two equal windows share an aligned anchor if the cover's differences give every residue."""
    if {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("the cover leaves out a difference")
    if period >= window:
        raise ValueError("the period must be smaller than the window")
    return window - period + 1


def anchor_places(n_words: int, size: int, period: int, cover: tuple) -> np.ndarray:
    at = np.arange(max(0, n_words - size + 1))
    return at[np.isin(at % period, cover)]


def _by_doc(hashes: np.ndarray, docs: np.ndarray):
    order = np.argsort(docs, kind="stable")
    return hashes[order], docs[order]


def _dealt(hashes, docs, settled, known_hashes, known_docs, buckets: int):
    """Entry rows for one batch: hashes go to buckets by a second mix of the hash, what is known already to any bucket."""
    out = []
    place = mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)
    order = np.argsort(place, kind="stable")
    edges = np.searchsorted(place[order], np.arange(buckets + 1))
    for b in range(buckets):
        k = order[edges[b]:edges[b + 1]]
        for kind, chosen in ((OPEN, k[~settled[k]]), (SETTLED, k[settled[k]])):
            if len(chosen):
                chosen = np.sort(chosen)
                out.append((b, kind, hashes[chosen].tobytes(), docs[chosen].tobytes()))
    if len(known_hashes):
        kh, kd = _by_doc(known_hashes, known_docs)
        for part, (h, d) in enumerate(zip(np.array_split(kh, min(buckets, 1 + len(kh) // 4096)), np.array_split(kd, min(buckets, 1 + len(kh) // 4096)))):
            out.append(((int(h[0] % np.uint64(buckets)) + part) % buckets, KNOWN, h.tobytes(), d.tobytes()))
    return out


def _read_entries(group: pa.Table):
    made = {}
    for kind in (OPEN, SETTLED, KNOWN):
        rows = group.filter(pa.compute.equal(group.column("kind"), kind))
        made[kind] = tuple(np.frombuffer(b"".join(rows.column(c).to_pylist()), t) for c, t in (("hashes", np.uint64), ("docs", np.int64)))
    return made


def _anchor_entries(window, period, cover, buckets):
    size = check_cover(window, period, cover)
    schema = arrow_schema(ENTRY)

    def run(batches):
        for b in slices(batches, ENTRY_ROWS):
            hashes, docs, twice = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                x = word_hashes(words_of(text.as_py()))
                if len(x) < window:
                    continue
                h, n = np.unique(window_hashes(x, size)[anchor_places(len(x), size, period, cover)], return_counts=True)
                hashes.append(h)
                docs.append(np.full(len(h), doc, np.int64))
                twice.append(n > 1)
            if not hashes:
                continue
            hashes, docs, twice = np.concatenate(hashes), np.concatenate(docs), np.concatenate(twice)
            kinds, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
            met = np.zeros(len(kinds), bool)
            met[inverse[twice]] = True
            met |= counts > 1
            known = met[inverse]
            one = ~known
            rows = _dealt(np.concatenate([hashes[one], kinds[met]]), np.concatenate([docs[one], np.zeros(met.sum(), np.int64)]),
                          np.concatenate([np.zeros(one.sum(), bool), np.ones(met.sum(), bool)]), hashes[known], docs[known], buckets)
            yield record_batch(list(zip(*rows)), schema)

    return run


def _shared_anchors(group: pa.Table) -> pa.Table:
    """Of one bucket: each document's anchors that also stand elsewhere."""
    e = _read_entries(group)
    both, counts = np.unique(np.concatenate([e[OPEN][0], e[SETTLED][0]]), return_counts=True)
    shared = np.isin(e[OPEN][0], both[counts > 1])
    return pa.table({"doc_id": np.concatenate([e[OPEN][1][shared], e[KNOWN][1]]), "hash": np.concatenate([e[OPEN][0][shared], e[KNOWN][0]]).view(np.int64)})


def windows_of(x: np.ndarray, window: int) -> np.ndarray:
    """One 64-bit value per window, of two independent window hashes."""
    return mixed(window_hashes(x, window, 0) + np.uint64(3) * window_hashes(x, window, 1))


def _window_entries(window, period, cover, buckets):
    size = check_cover(window, period, cover)
    schema = arrow_schema(ENTRY)

    def run(batches):
        for b in slices(batches, ENTRY_ROWS):
            hashes, docs = [], []
            for doc, packed, shared in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), list_values(b.column(2))):
                x = word_hashes(unpack(packed))
                at = anchor_places(len(x), size, period, cover)
                hit = at[np.isin(window_hashes(x, size)[at], shared)]
                n = len(x) - window + 1
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, np.clip(hit - (window - size), 0, n), 1)
                np.add.at(edge, np.clip(hit + 1, 0, n), -1)
                h = np.unique(windows_of(x, window)[np.cumsum(edge[:n]) > 0])
                hashes.append(h)
                docs.append(np.full(len(h), doc, np.int64))
            if not hashes:
                continue
            hashes, docs = np.concatenate(hashes), np.concatenate(docs)
            order = np.lexsort((docs, hashes))
            hashes, docs = hashes[order], docs[order]
            later = np.r_[False, hashes[1:] == hashes[:-1]][:len(hashes)]
            first_doc = docs[np.maximum.accumulate(np.where(later, 0, np.arange(len(docs))))]
            again = later & (docs != first_doc)
            lead_h, lead_d = _by_doc(hashes[~later], docs[~later])
            rows = _dealt(lead_h, lead_d, np.zeros(len(lead_h), bool), hashes[again], docs[again], buckets)
            if rows:
                yield record_batch(list(zip(*rows)), schema)

    return run


def _earlier_windows(group: pa.Table) -> pa.Table:
    """Of one bucket: each document's windows that also stand in a document of smaller doc_id."""
    e = _read_entries(group)
    h, d = e[OPEN]
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    start = np.r_[True, h[1:] != h[:-1]][:len(h)]
    first = d[np.maximum.accumulate(np.where(start, np.arange(len(h)), 0))] if len(h) else d
    again = d != first
    return pa.table({"doc_id": np.concatenate([d[again], e[KNOWN][1]]), "hash": np.concatenate([h[again], e[KNOWN][0]]).view(np.int64)})


def list_values(column) -> list:
    """The lists of an Arrow list column as unsigned arrays, None for null."""
    flat, at = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    valid = column.is_valid().to_pylist()
    return [flat[at[k]:at[k + 1]] if ok else None for k, ok in enumerate(valid)]


def unpack(packed: bytes | None) -> list[bytes]:
    return zstandard.decompress(packed).split() if packed else []


def _packed(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Texts compressed while they are moved; the other columns travel in the same row."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    ddl = ", ".join(["doc_id bigint", "packed binary", *(f"`{c}` {kinds[c]}" for c in carry)])
    schema = arrow_schema(ddl)

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for b in slices(batches):
            packed = [None if t is None else press.compress(t.encode()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(packed, pa.binary()), *(b.column(2 + i).cast(schema.field(2 + i).type) for i in range(len(carry)))], schema=schema)

    return docs.select("doc_id", "text", *carry).mapInArrow(run, ddl)


RESULT = "n_words bigint, n_removed bigint, removed array<struct<start:bigint,stop:bigint>>, kept string"


def _cut_texts(window, carry_ddl: list[str], as_is: bool):
    ddl = ", ".join(["doc_id bigint", RESULT, *carry_ddl])
    schema = arrow_schema(ddl)

    def untouched(packed, words):
        if as_is:
            return len(words), 0, [], None if packed is None else zstandard.decompress(packed).decode()
        return len(words), 0, [], b" ".join(words).decode()

    def one(packed, flagged):
        words = unpack(packed)
        n = len(words)
        if n < window:
            return untouched(packed, words)
        h = windows_of(word_hashes(words), window)
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        again = first[inverse] != np.arange(len(h))
        if flagged is not None:
            again |= np.isin(h, flagged)
        if not again.any():
            return untouched(packed, words)
        edge = np.zeros(n + 1, np.int64)
        at = np.flatnonzero(again)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        gone = np.cumsum(edge[:n]) > 0
        turn = np.flatnonzero(np.diff(np.r_[False, gone, False]))
        spans = [{"start": int(a), "stop": int(z)} for a, z in turn.reshape(-1, 2)]
        return n, int(gone.sum()), spans, b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode()

    def run(batches):
        for b in slices(batches):
            if b.num_rows:
                made = list(zip(*[one(p, f) for p, f in zip(b.column(1).to_pylist(), list_values(b.column(2)))]))
                rest = [b.column(3 + i).cast(schema.field(5 + i).type) for i in range(len(carry_ddl))]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, schema.field(1 + k).type) for k, c in enumerate(made)), *rest], schema=schema)

    return run, ddl


def dedup_substrings(docs: DataFrame, carry: tuple = (), window: int = WINDOW, period: int = PERIOD, cover: tuple = COVER, as_is: bool = False) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts earlier (smaller doc_id, or earlier in
    the same document).

    ``docs(doc_id, text, *carry)`` to ``(doc_id, n_words, n_removed, removed spans of words, kept, *carry)``; ``kept``
    is the kept words joined by one space; with ``as_is`` a text that loses nothing comes back unchanged, null as null.
    Null and empty texts have no words. Rows without doc_id take no part; rows
    that share a doc_id are judged one by one against other documents and themselves, never against each other.

    Anchors of ``window - period + 1`` words are hashed only at cover positions modulo ``period``: two equal windows
    share one at the same depth, wherever they start. Anchors that stand nowhere else leave at once. Documents with a
    shared anchor extend it to the windows around it, and the windows find their earliest document. Every hash is a
    fixed amount of data however common it is: each input batch sends one entry for it and settles its own repeats, so a
    bucket holds a hash partition of the corpus and a passage found everywhere adds one entry a batch. Windows are told
    apart by a 64-bit value within buckets, of two independent hashes."""
    check_cover(window, period, cover)
    carry = list(carry)
    buckets = BUCKETS_PER_PARTITION * partitions_of(docs.sparkSession)
    packed = _packed(docs.filter("doc_id IS NOT NULL"), carry)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    shared = (docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_anchor_entries(window, period, cover, buckets), ENTRY).groupBy("bucket")
              .applyInArrow(_shared_anchors, "doc_id bigint, hash bigint").groupBy("doc_id").agg(F.collect_set("hash").alias("shared")))
    extended = packed.join(shared, "doc_id").select("doc_id", "packed", "shared")
    flagged = (extended.mapInArrow(_window_entries(window, period, cover, buckets), ENTRY).groupBy("bucket")
               .applyInArrow(_earlier_windows, "doc_id bigint, hash bigint").groupBy("doc_id").agg(F.collect_set("hash").alias("flagged")))
    run, ddl = _cut_texts(window, [f"`{c}` {kinds[c]}" for c in carry], as_is)
    return packed.join(flagged, "doc_id", "left").select("doc_id", "packed", "flagged", *carry).mapInArrow(run, ddl)
