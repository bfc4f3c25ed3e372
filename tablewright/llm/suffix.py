"""Removal of repeated byte strings with a family of suffix indexes.

A string of ``LENGTH`` bytes is named by its anchor: the smallest hash of the
``GRAM``-byte pieces inside it. Equal strings have equal anchors at equal
places, so anchors alone decide which task compares which suffixes, and about
one suffix in thirty carries an anchor:

1. ``find``: a document becomes records (anchor hash, first suffix, number of
   suffixes, distance of the anchor). They are dealt by anchor hash.
2. ``shared``: records whose anchor occurs once are done. The rest go back to
   their documents.
3. ``contexts``: the text of these records is dealt by anchor hash again.
4. ``scan``: records arrive in document order, in batches. A batch gets its
   sorted array of suffix keys, which is merge-scanned against the sorted
   levels that are there; suffixes found in a level, or earlier in the batch,
   are repeats once their bytes are compared. What is new becomes a level, and
   equal-sized levels merge.
5. ``removal``: the repeats of a document are united and cut out of its text.

Suffixes only matter up to ``LENGTH`` bytes, and only whether they are equal.
So the arrays are sorted by a 64-bit key of those bytes instead of by the bytes
themselves, and carry where the suffix stands: what has an equal key is a repeat
only if all ``LENGTH`` bytes are equal. Hashes decide who meets, never what is cut.

Before records or contexts leave a task, those of one anchor or one passage in
the task's documents are combined, so a passage that a third of all documents
hold costs a record per group of documents. All steps share one exchange of the
texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import NO_ID, table, text_bytes

LENGTH = 100
GRAM = 36
PART_BYTES = 8 << 20  # text in a part: what a task holds at once, but for a longer single text
SLICE = 1 << 20  # bytes hashed at once
PLACES = 22  # bits for a place in a slice
BATCH = 1 << 14  # records in a new suffix array
COMPARED = 1 << 16  # strings compared at once
# fixed values: odd multipliers of the hashes
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)
# a document is named by its id and 96 bits of its text, as ids may be null or repeat; records carry its number among
# the sorted names of its part instead, and names only where documents of different parts are put in order
RECORD = np.dtype([("h", "<u8"), ("own", "<u4"), ("start", "<i4"), ("n", "<u2"), ("at", "<u2"), ("part", "<u4")])
NAME = ["doc", "tag", "crc"]
NAMED = np.dtype([*((n, RECORD[n].str) for n in RECORD.names), ("doc", "<i8"), ("tag", "<i8"), ("crc", "<u4")])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * MIX
    x = (x ^ x >> np.uint64(27)) * MIX2
    return x ^ x >> np.uint64(31)


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` bytes of ``data``, by doubling."""
    one = mixed(np.arange(1, 257, dtype=np.uint64) * BASE)[data]
    out, done, power = None, 0, BASE
    block, size = one, 1
    while True:
        if width & size:
            if out is None:
                out, done = block, size
            else:
                n = len(data) - done - size + 1
                out = out[:n] * power + block[done : done + n]
                done += size
        if done == width:
            return mixed(out)
        n = len(block) - size
        block = block[:n] * power + block[size : size + n]
        power = np.uint64(int(power) * int(power) % 2**64)
        size *= 2


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every gram, and the place of the anchor of every ``length`` bytes (leftmost of the smallest)."""
    hashes = window_hashes(data, gram)
    low = np.uint64((1 << PLACES) - 1)  # the same for every slice, so that equal strings agree
    key = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    span, size = length - gram + 1, 1
    while size * 2 <= span:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < span:
        key = np.minimum(key[: len(key) - (span - size)], key[span - size :])
    return hashes, (key & low).astype(np.int64)


def _slices(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined into slices: bytes, text number, place of the slice's piece in its text, piece starts.

    A text longer than a slice comes in pieces that overlap by ``length - 1`` bytes.
    """
    pieces: list[tuple[int, int, bytes]] = []
    held = 0

    def out():
        data = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
        starts = np.cumsum([0] + [len(p) for _, _, p in pieces])
        return data, np.array([t for t, _, _ in pieces]), np.array([a for _, a, _ in pieces]), starts

    for number, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), SLICE):
            piece = text[at : at + SLICE + length - 1]
            if len(piece) < length:
                continue
            if held and held + len(piece) > SLICE:
                yield out()
                pieces, held = [], 0
            pieces.append((number, at, piece))
            held += len(piece)
    if pieces:
        yield out()


def records(texts: list[bytes], length: int, gram: int) -> np.ndarray:
    """A record for every stretch of ``length``-byte strings with one anchor."""
    parts = [np.zeros(0, RECORD)]
    for data, number, place, starts in _slices(texts, length):
        hashes, anchor = anchors(data, length, gram)
        piece = np.repeat(np.arange(len(number)), np.diff(starts))[: len(anchor)]
        whole = np.arange(len(anchor)) + length <= starts[piece + 1]  # within one text
        first = np.ones(len(anchor), bool)
        first[1:] = (anchor[1:] != anchor[:-1]) | ~whole[:-1] | (piece[1:] != piece[:-1])
        begin = np.flatnonzero(first & whole)
        edge = np.flatnonzero(first | ~whole)
        stop = np.append(edge, len(anchor))[np.searchsorted(edge, begin, side="right")]
        out = np.zeros(len(begin), RECORD)
        out["h"], out["n"], out["at"] = hashes[anchor[begin]], stop - begin, anchor[begin] - begin
        own = piece[begin]
        out["start"] = begin - starts[own] + place[own]
        out["own"] = number[own]
        parts.append(out)
    return np.concatenate(parts)


def _packed(found: np.ndarray) -> bytes:
    """Records column by column, which compresses well."""
    return b"".join(np.ascontiguousarray(found[n]).tobytes() for n in found.dtype.names)


def _unpacked(blob: bytes, kind: np.dtype) -> np.ndarray:
    n, at = len(blob) // kind.itemsize, 0
    out = np.zeros(n, kind)
    for name in kind.names:
        out[name] = np.frombuffer(blob, kind[name], n, at)
        at += n * kind[name].itemsize
    return out


def _all(blobs: list[bytes], kind: np.dtype = RECORD) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind)] + [_unpacked(b, kind) for b in blobs])


def _as(found: np.ndarray, kind: np.dtype) -> np.ndarray:
    """The columns of ``kind``; those that are not there are zero."""
    out = np.zeros(len(found), kind)
    for name in set(kind.names) & set(found.dtype.names):
        out[name] = found[name]
    return out


def _names(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the documents of a part, sorted, the first row of each, and the document of every row.

    Rows with the same id and text are one document. The order rests on the names
    alone, so every step that sees the part's rows numbers them alike.
    """
    names = np.stack([rows[c].to_numpy() for c in NAME], 1)
    if not len(names):
        return names, np.zeros(0, int), np.zeros(0, int)
    some, first, own = np.unique(names, axis=0, return_index=True, return_inverse=True)
    return some, first, own.reshape(-1)


def _order(found: np.ndarray) -> np.ndarray:
    return np.lexsort((found["start"], *(found[c] for c in reversed(NAME))))


def _dealt(to: np.ndarray, kind: int, found: np.ndarray, extra: list[bytes] | None = None) -> list[tuple]:
    """Rows ``(to, kind, blob, extra)``, a blob for each receiver."""
    out = []
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order])) + 1
    for some in np.split(order, cuts) if len(order) else []:
        out.append((int(to[some[0]]), kind, _packed(found[some]), b"".join(extra[i] for i in some) if extra else b""))
    return out


def _table(rows: list[tuple]) -> pa.Table:
    to, kind, blob, extra = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({
        "part": pa.array(to, pa.int64()), "kind": pa.array(kind, pa.int32()),
        "blob": pa.array(blob, pa.binary()), "extra": pa.array(extra, pa.binary()),
    })


MOVED = "part bigint, kind int, blob binary, extra binary"
ASK, WITNESS, TOLD = 0, 1, 2  # does this anchor occur elsewhere; it occurs here as well; already known to repeat


def _find(parts: int, length: int, gram: int):
    def run(rows: pa.Table) -> pa.Table:
        found = records(rows["text"].take(_names(rows)[1]).to_pylist(), length, gram)
        found["part"] = rows["part"][0].as_py()
        found = found[np.argsort(found["h"], kind="stable")]
        new = np.ones(len(found), bool)
        new[1:] = found["h"][1:] != found["h"][:-1]
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(found)))
        alone = np.repeat(count == 1, count)
        deal = (found["h"] % np.uint64(parts)).astype(np.int64)
        out = _dealt(deal[alone], ASK, found[alone])
        # of an anchor with several records here one witness travels; the records themselves only return
        seen = begin[count > 1]
        out += _dealt(deal[seen], WITNESS, found[seen])
        told = found[~alone]
        out += _dealt((told["part"].astype(np.int64) + 1) % parts, TOLD, told)
        return _table(out)

    return run


def _shared():
    def run(rows: pa.Table) -> pa.Table:
        kinds, blobs = rows["kind"].to_numpy(), rows["blob"].to_pylist()
        ask, witness, told = (_all([b for b, k in zip(blobs, kinds, strict=True) if k == kind]) for kind in (ASK, WITNESS, TOLD))
        every = np.sort(np.concatenate([ask["h"], witness["h"]]))
        often = np.searchsorted(every, ask["h"], side="right") - np.searchsorted(every, ask["h"]) > 1
        out = np.concatenate([ask[often], told])
        return _table(_dealt(out["part"].astype(np.int64), ASK, out))

    return run


def _by_document(found: np.ndarray, n: int) -> tuple[np.ndarray, list[int]]:
    """The records of a part in document order, and where those of each of its ``n`` documents start, and the end."""
    found = found[np.lexsort((found["start"], found["own"]))]
    return found, np.searchsorted(found["own"], np.arange(n + 1)).tolist()


CONTEXT, REPEAT = 0, 1


def _contexts(parts: int, length: int):
    """The text of the strings with a shared anchor."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, first, _ = _names(left)
        texts = left["text"].take(first).to_pylist()
        found, begin = _by_document(_all(right["blob"].to_pylist()), len(texts))
        starts, counts, places = (found[c].tolist() for c in ("start", "n", "at"))
        keep, repeats, pieces = [], [], []
        at_home: dict[tuple, int] = {}
        for i, text in enumerate(texts):
            for r in range(begin[i], begin[i + 1]):
                start, at = starts[r], places[r]
                piece = text[start : start + counts[r] - 1 + length]
                # the same passage cut the same way: documents come in order, so the first is the earliest
                if at_home.setdefault((at, piece), i) != i:
                    repeats.append(r)
                else:
                    keep.append(r)
                    pieces.append(piece)
        kept, rest = _as(found[np.array(keep, np.int64)], NAMED), found[np.array(repeats, np.int64)]
        for c, values in zip(NAME, names.T, strict=True):
            kept[c] = values[kept["own"]]
        order = np.argsort(kept["h"], kind="stable")  # alike texts lie together, which compresses well
        kept, pieces = kept[order], [pieces[i] for i in order.tolist()]
        out = _dealt((kept["h"] % np.uint64(parts)).astype(np.int64), CONTEXT, kept, pieces)
        return _table(out + _dealt((rest["part"].astype(np.int64) + 1) % parts, REPEAT, rest))

    return run


class SuffixLevels:
    """Sorted arrays of suffix keys with the place of each suffix, each level at least twice as large as the next."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where the suffix with each of the sorted ``keys`` stands; -1 for those that no level holds."""
        found = np.full(len(keys), -1, np.int64)
        for level, where in self.levels:
            at = np.minimum(np.searchsorted(level, keys), len(level) - 1)
            hit = level[at] == keys
            found[hit] = where[at[hit]]
        return found

    def add(self, keys: np.ndarray, places: np.ndarray) -> None:
        """A new level of sorted ``keys``; levels of its size merge into it."""
        places = places.astype(np.uint32 if not len(places) or places.max() < 2**32 else np.int64)
        while self.levels and len(self.levels[-1][0]) < 2 * len(keys):
            level, where = self.levels.pop()
            keys, places = np.concatenate([level, keys]), np.concatenate([where, places])
            order = np.argsort(keys, kind="stable")  # two sorted runs: a merge
            keys, places = keys[order], places[order]
        if len(keys):
            self.levels.append((keys, places))


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes from each place of ``a`` are those from the place of ``b``."""
    out = np.ones(len(a), bool)
    windows = np.lib.stride_tricks.sliding_window_view(data, length) if len(a) else data
    for at in range(0, len(a), COMPARED):
        some = slice(at, at + COMPARED)
        out[some] = (windows[a[some]] == windows[b[some]]).all(1)
    return out


def repeats(found: np.ndarray, texts: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """``(record, from, to)``: stretches of strings that an earlier record has as well.

    ``texts`` has the bytes of the strings of each record. Records are taken in
    document order, in batches of ``BATCH``. A string whose key another one has
    that is not equal is kept apart and compared in full.
    """
    index, out = SuffixLevels(), []
    odd: dict[int, set[bytes]] = {}
    order = _order(found)
    whole = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
    start = 0
    for at in range(0, len(order), BATCH):
        some = order[at : at + BATCH]
        n = found["n"][some].astype(np.int64)
        starts = start + np.cumsum(n + length - 1) - (n + length - 1)
        stop = int(starts[-1] + n[-1] + length - 1)
        base = np.cumsum(n) - n
        place = np.repeat(starts - base, n) + np.arange(n.sum())
        keys = window_hashes(whole[start:stop], length)[place - start]
        start = stop
        rank = np.argsort(keys, kind="stable")  # the batch's suffix array; equal suffixes stay in document order
        ranked, places = keys[rank], place[rank]
        new = np.ones(len(keys), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        first = places[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]  # the earliest with the key
        known = index.places(ranked)
        first = np.where(known >= 0, known, first)
        again = np.flatnonzero(~new | (known >= 0))
        equal = same_bytes(whole, places[again], first[again], length)
        index.add(ranked[new & (known < 0)], places[new & (known < 0)])
        flag = np.zeros(len(keys), bool)
        flag[rank[again[equal]]] = True
        for i in sorted(again[~equal], key=lambda i: places[i]):
            string = whole[places[i] : places[i] + length].tobytes()
            held = odd.setdefault(int(ranked[i]), set())
            flag[rank[i]] = string in held
            held.add(string)
        owner = np.repeat(np.arange(len(some)), n)
        edge = np.ones(len(flag), bool)
        edge[1:] = (flag[1:] != flag[:-1]) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(edge)
        end = np.append(begin[1:], len(flag))
        hit = flag[begin]
        begin, end = begin[hit], end[hit]
        own = owner[begin]
        out += zip(some[own].tolist(), (begin - base[own]).tolist(), (end - base[own]).tolist(), strict=True)
    return out


def _scan(parts: int, length: int):
    def run(rows: pa.Table) -> pa.Table:
        kinds, blobs, extra = rows["kind"].to_numpy(), rows["blob"].to_pylist(), rows["extra"].to_pylist()
        context = [i for i, k in enumerate(kinds) if k == CONTEXT]
        found = _all([blobs[i] for i in context], NAMED)
        text, at, pieces = b"".join(extra[i] for i in context), 0, []
        for n in (found["n"].astype(np.int64) + length - 1).tolist():
            pieces.append(text[at : at + n])
            at += n
        hits = repeats(found, pieces, length)
        own = np.array([h[0] for h in hits], np.int64)
        cut = found[own]
        cut["start"] += np.array([h[1] for h in hits], np.int64)
        cut["n"] = np.array([h[2] - h[1] for h in hits], np.int64)
        out = np.concatenate([_as(cut, RECORD), _all([b for b, k in zip(blobs, kinds, strict=True) if k == REPEAT])])
        return _table(_dealt(out["part"].astype(np.int64), REPEAT, out))

    return run


REMOVED = "doc bigint, no_id boolean, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary"


def _spans(found: np.ndarray, length: int) -> np.ndarray:
    """Maximal byte runs covered by the strings of the records, which come in order of start."""
    start, stop = found["start"], found["start"] + found["n"].astype(np.int64) - 1 + length
    reach = np.maximum.accumulate(stop)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    return np.stack([start[begin], reach[np.append(begin[1:], len(start)) - 1]], 1)


def _removal(length: int, texts_too: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, _, own = _names(left)
        found, begin = _by_document(_all(right["blob"].to_pylist()), len(names))
        size, removed, spans, kept = [], [], [], []
        for i, text in zip(own.tolist(), left["text"].to_pylist(), strict=True):
            here = found[begin[i] : begin[i + 1]]
            cut = _spans(here, length).tolist() if len(here) else []
            at, rest = 0, []
            for a, b in cut:
                rest.append(text[at:a])
                at = b
            rest.append(text[at:])
            whole = b"".join(rest)
            size.append(len(text))
            removed.append(len(text) - len(whole))
            spans.append([{"start": a, "stop": b} for a, b in cut])
            kept.append(whole if texts_too else hashlib.sha256(whole).hexdigest().encode())
        return pa.table({
            "doc": left["doc"], "no_id": left["no_id"], "n_bytes": pa.array(size, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array([len(s) for s in spans], pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
            "kept": pa.array(kept, pa.binary()),
        })

    return run


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, part_bytes: int = PART_BYTES, digest: bool = False
) -> DataFrame:
    """Every row of ``docs`` without the bytes that a ``length``-byte string covers which also starts earlier.

    Earlier is: a smaller doc_id, or the same document and an earlier start.
    Returns doc_id, n_bytes, n_removed, n_spans, spans (start, stop) and kept
    (the remaining bytes, or their SHA-256 as hex with ``digest``). A null text
    is empty; texts under ``length`` bytes lose nothing. A null doc_id comes
    last. Different texts with one doc_id, or without one, are taken in order of
    a hash; rows that repeat id and text are one document and get equal results.
    An empty table gives no row; other columns are ignored.
    """
    if not 8 <= gram < length < 2**15:
        raise ValueError("need 8 <= gram < length < 32768")
    total = docs.agg(F.sum(text_bytes(F.col("text")))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), F.col("doc_id").isNull().alias("no_id"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
    )
    rows = rows.select("doc", "no_id", F.xxhash64("text").alias("tag"), F.crc32("text").alias("crc"), "text")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc", "tag"), F.lit(parts)))
    by_part = rows.groupBy("part")
    asked = by_part.applyInArrow(_find(parts, length, gram), MOVED)
    answers = asked.groupBy("part").applyInArrow(_shared(), MOVED)
    around = by_part.cogroup(answers.groupBy("part")).applyInArrow(_contexts(parts, length), MOVED)
    hits = around.groupBy("part").applyInArrow(_scan(parts, length), MOVED)
    out = by_part.cogroup(hits.groupBy("part")).applyInArrow(_removal(length, not digest), REMOVED)
    kept = F.col("kept").cast("string").alias("kept") if digest else F.col("kept")
    return out.select(F.when(~F.col("no_id"), F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "spans", kept)


def op10(spark, folder: str) -> DataFrame:
    """What every document loses to earlier 100-byte strings."""
    out = remove_repeats(table(spark, folder, "documents"), digest=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))
