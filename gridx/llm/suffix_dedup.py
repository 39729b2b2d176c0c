"""Exact substring de-duplication: bytes covered by a string of `length` bytes that starts in an earlier document.

Distribution. Equal windows have equal k-byte grams, so the gram of least hash in a window (its anchor) is the same
wherever the window occurs. Each document is cut into runs of consecutive windows with one anchor; a run (anchor
hash, hash of the run's bytes, document, position) costs some 14 bytes and is dealt by its anchor, so all places
where a window can recur meet in one group. Runs with equal hashes (96 bits) are pre-aggregated, first by the task
that cuts them, then in that group: all but those of the smallest document are covered. The remaining different runs
of one anchor send their bytes, once, to a block. An anchor with more bytes than a block sends windows instead, dealt
by their own hashes; equal windows of one task are compared there and all but the smallest document's are covered.

Method. In a block the runs' bytes are transformed with a Burrows-Wheeler transform, and intervals of suffixes are
extended backwards, breadth first, by one byte a level. The level at which a boundary between neighbouring suffixes
appears is the length of their common prefix; expansion ends at `length`, so boundaries never reached separate
nothing shorter, and suffixes between reached boundaries share at least `length` bytes. A window is covered if such
an interval holds a window of a smaller document. The sort behind the transform (ranks that double in width) keeps no
classes of its last width: boundaries come from the expansion. Blocks are bounded.

Defined results: a null text is the empty text; texts under `length` bytes lose nothing; rows that repeat a doc_id
never cover one another; a null doc_id counts as the largest; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridx.llm import textvec as tv
from gridx.llm.common import LAST_ID, cut, n_groups, release, text_bytes

U = np.uint64
LENGTH, GRAM = 50, 16
RUN_MOST = 64
BLOCK_BYTES = 1 << 19
#: Runs that are gathered before they are dealt out.
SEND_RUNS = 1 << 19
_LOW48 = U((1 << 48) - 1)


# ---------------------------------------------------------------------------------------------------------- blobs
def pack(**columns: np.ndarray) -> bytes:
    """Equal-length integer columns as byte planes (constant high planes compress away in the shuffle)."""
    return b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns.values())


def unpack(blob: bytes, **kinds: type) -> dict[str, np.ndarray]:
    width = sum(np.dtype(k).itemsize for k in kinds.values())
    n, at, out = len(blob) // width, 0, {}
    raw = np.frombuffer(blob, np.uint8)
    for name, kind in kinds.items():
        size = np.dtype(kind).itemsize
        out[name] = np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).reshape(n)
        at += n * size
    return out


def dealt(where: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(group, row numbers in order) for each group that has rows."""
    order = np.argsort(where, kind="stable")
    bounds = np.searchsorted(where[order], np.arange(n + 1))
    for g in np.flatnonzero(np.diff(bounds)):
        yield int(g), order[bounds[g] : bounds[g + 1]]


# -------------------------------------------------------------------------------------------------------- anchors
def runs(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, byte hash, document, first window, windows) of each run of windows that share an anchor."""
    none = np.zeros(0, np.int64)
    n = len(data) - length + 1
    if n <= 0:
        return none.astype(U), none.astype(U), none, none, none
    prefix = tv.prefix_hash(data)
    grams = len(data) - gram + 1
    least = tv.window_hashes(prefix, slice(gram, None), slice(0, grams), slice(0, grams))
    span, width = 1, length - gram + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: span - width], least[width - span :])
    size = np.diff(off)
    long = np.flatnonzero(size >= length)
    inside = np.zeros(len(data) + 1, np.int32)
    inside[off[:-1][long]] += 1
    np.subtract.at(inside, off[1:][long] - length + 1, 1)
    inside = np.cumsum(inside[:n]) > 0
    first = np.ones(n, bool)
    first[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    first &= inside
    last = np.ones(n, bool)
    last[:-1] = first[1:] | ~inside[1:]
    last &= inside
    a = np.flatnonzero(first)
    count = np.flatnonzero(last) + 1 - a
    if len(count) and count.max() > RUN_MOST:  # periodic text: one run may hold many windows
        parts = -(-count // RUN_MOST)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        a, count = np.repeat(a, parts) + nth * RUN_MOST, np.minimum(np.repeat(count, parts) - nth * RUN_MOST, RUN_MOST)
    doc = np.searchsorted(off, a, side="right") - 1
    end = a + count - 1 + length
    whole = tv.window_hashes(prefix, end, a, a) + count.astype(U)
    return least[a] & _LOW48, tv.mix(whole) & _LOW48, doc, a - off[doc], count


def _six(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :6]


def _eight(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :6] = x
    return out.view(U).reshape(-1)


def _marks_of(keys: np.ndarray, at: np.ndarray, n: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, covered stretches of windows) of rows, neighbouring stretches joined."""
    order = np.lexsort((at, keys))
    keys, at, n = keys[order], at[order].astype(np.int64), n[order].astype(np.int64)
    head = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (at[1:] != at[:-1] + n[:-1])))) if len(keys) else np.zeros(0, np.int64)
    n = np.add.reduceat(n, head) if len(head) else n
    keys, at = keys[head], at[head]
    for b, r in dealt((keys.astype(U) % U(buckets)).astype(np.int64), buckets):
        yield b, pack(rk=keys[r], at=at[r].astype(np.uint32), n=n[r].astype(np.uint32))


def _above_least(ids: np.ndarray, *names: np.ndarray) -> np.ndarray:
    """Rows whose id is above the least one among the rows of the same names."""
    order = np.lexsort((ids, *names))
    new = np.zeros(len(ids), bool)
    new[:1] = True
    for x in names:
        new[1:] |= x[order][1:] != x[order][:-1]
    least = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(ids) else ids
    out = np.zeros(len(ids), bool)
    out[order] = ids[order] > least
    return out


_SENT = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("docs", pa.binary()), ("runs", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(schema.types)], schema=schema)


def _send_runs(parts: int, buckets: int, length: int, gram: int):
    def packed(gathered: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, c, ids, keys, at, n = map(np.concatenate, zip(*gathered, strict=True))
        covered = _above_least(ids, c, h)
        out: list[tuple] = [(b % parts, b, None, blob) for b, blob in _marks_of(keys[covered], at[covered], n[covered], buckets)]
        h, c, ids, keys, at, n = (x[~covered] for x in (h, c, ids, keys, at, n))
        for g, rows in dealt((h % U(parts)).astype(np.int64), parts):
            first = np.flatnonzero(np.concatenate(([True], keys[rows][1:] != keys[rows][:-1])))
            docs = pack(id=ids[rows][first], rk=keys[rows][first], n=np.diff(np.append(first, len(rows))).astype(np.uint32))
            body = _six(h[rows]).T.tobytes() + _six(c[rows]).T.tobytes() + pack(at=at[rows].astype(np.uint32), n=n[rows].astype(np.uint8))
            out.append((g, None, docs, body))
        return _batch(out, _SENT)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, held = [], 0
        for batch in batches:
            data, off = tv.buffers(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            keys = batch.column("rk").to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in tv.chunks(off):
                h, c, doc, at, n = runs(data[off[i] : off[j]], off[i : j + 1] - off[i], length, gram)
                gathered.append((h, c, ids[i + doc], keys[i + doc], at.astype(np.uint32), n.astype(np.uint8)))
                held += len(h)
                if held >= SEND_RUNS:
                    yield packed(gathered)
                    gathered, held = [], 0
        if held:
            yield packed(gathered)
        tv.tidy()

    return deal


def _read_runs(table: pa.Table) -> tuple[np.ndarray, ...]:
    h, c, at, n, ids, keys = [], [], [], [], [], []
    for docs, body in zip(table["docs"].to_pylist(), table["runs"].to_pylist(), strict=True):
        d = unpack(docs, id=np.int64, rk=np.int64, n=np.uint32)
        raw = np.frombuffer(body, np.uint8)
        m = len(raw) // 17
        h.append(_eight(raw[: 6 * m].reshape(6, m).T))
        c.append(_eight(raw[6 * m : 12 * m].reshape(6, m).T))
        rest = unpack(body[12 * m :], at=np.uint32, n=np.uint8)
        at.append(rest["at"])
        n.append(rest["n"])
        ids.append(np.repeat(d["id"], d["n"]))
        keys.append(np.repeat(d["rk"], d["n"]))
    return tuple(map(np.concatenate, (h, c, at, n, ids, keys)))


#: What is known of a bucket's rows: windows that are covered, runs whose bytes a block needs, runs whose windows are dealt.
COVERED, ASKED, HOT = 0, 1, 2
_MARKS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
_MARKS_DDL = "bucket int, kind int, blob binary"


def _marks(found: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([_batch(found, _MARKS)])


def _meet(buckets: int, length: int, most: int):
    """For the runs of a group of anchors: what identical runs cover, and whose bytes must be compared."""

    def meet(table: pa.Table) -> pa.Table:
        known = table.filter(pc.is_valid(table["bucket"]))
        found = [(b, COVERED, blob) for b, blob in zip(known["bucket"].to_pylist(), known["runs"].to_pylist(), strict=True)]
        sent = table.filter(pc.is_null(table["bucket"]))
        if not len(sent):
            return _marks(found)
        h, c, at, n, ids, keys = _read_runs(sent)
        covered = _above_least(ids, c, h)
        found += [(b, COVERED, blob) for b, blob in _marks_of(keys[covered], at[covered], n[covered], buckets)]
        # an anchor whose other runs differ, and come from several documents, is compared on bytes
        left = np.flatnonzero(~covered)
        left = left[np.lexsort((ids[left], c[left], h[left]))]
        hh = h[left]
        new_h = np.concatenate(([True], hh[1:] != hh[:-1])) if len(left) else np.zeros(0, bool)
        first = np.flatnonzero(new_h)
        of = np.cumsum(new_h) - 1
        if len(left):
            shared = np.minimum.reduceat(ids[left], first) != np.maximum.reduceat(ids[left], first)
            hot = np.add.reduceat(n[left].astype(np.int64) + length - 1, first) > most
            for kind, pick in ((ASKED, left[(shared & ~hot)[of]]), (HOT, left[(shared & hot)[of]])):
                pick = pick[np.lexsort((at[pick], keys[pick]))]
                for b, r in dealt((keys[pick].astype(U) % U(buckets)).astype(np.int64), buckets):
                    r = pick[r]
                    found.append((b, kind, _six(h[r]).T.tobytes() + pack(rk=keys[r], at=at[r], n=n[r])))
        return _marks(found)

    return meet


_CTX = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("meta", pa.binary()), ("bytes", pa.binary())])


def _fetch(parts: int, buckets: int, length: int):
    """Bytes of the runs that were asked for, dealt by anchor; of hot anchors their windows, dealt by their hashes."""

    def fetch(docs: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(asked) or not len(docs):
            return pa.Table.from_batches([], schema=_CTX)
        data, off = tv.buffers(docs["text"])
        keys, doc_ids = docs["rk"].to_numpy(), docs["doc_id"].to_numpy()
        order = np.argsort(keys, kind="stable")
        out: list[tuple] = []

        def runs_of(kind: int) -> tuple[np.ndarray, ...]:
            blobs = asked.filter(pc.equal(asked["kind"], kind))["blob"].to_pylist()
            if not blobs:
                return tuple(np.zeros(0, t) for t in (np.int64, np.uint32, np.uint8, np.int64, U, np.int64))
            h = np.concatenate([_eight(np.frombuffer(b, np.uint8)[: 6 * (len(b) // 19)].reshape(6, -1).T) for b in blobs])
            found = [unpack(b[6 * (len(b) // 19) :], rk=np.int64, at=np.uint32, n=np.uint8) for b in blobs]
            rk, at, n = (np.concatenate([f[k] for f in found]) for k in ("rk", "at", "n"))
            row = order[np.searchsorted(keys[order], rk)]
            return rk, at, n, doc_ids[row], h, off[row] + at

        def send(rk, at, n, ids, h, start) -> None:
            size = n.astype(np.int64) + length - 1
            for g, r in dealt((h % U(parts)).astype(np.int64), parts):
                index = np.arange(size[r].sum()) + np.repeat(start[r] - (np.cumsum(size[r]) - size[r]), size[r])
                out.append((g, None, pack(rk=rk[r], at=at[r], n=n[r], id=ids[r], h=h[r]), data[index].tobytes()))

        send(*runs_of(ASKED))
        rk, at, n, ids, _, start = runs_of(HOT)
        for i in range(0, len(rk), 1 << 14):
            r = np.repeat(np.arange(i, min(i + (1 << 14), len(rk))), n[i : i + (1 << 14)])
            nth = np.arange(len(r)) - np.repeat(np.cumsum(n[i : i + (1 << 14)], dtype=np.int64) - n[i : i + (1 << 14)], n[i : i + (1 << 14)])
            begin = start[r] + nth
            text = data[begin[:, None] + np.arange(length)]
            _, name = np.unique(text.view(f"V{length}").reshape(-1), return_inverse=True)
            covered = _above_least(ids[r], name.reshape(-1))
            place = at[r] + nth.astype(np.uint32)
            out += [(b % parts, b, blob, None) for b, blob in _marks_of(rk[r][covered], place[covered], np.ones(int(covered.sum()), np.int64), buckets)]
            stay = np.flatnonzero(~covered)
            prefix = tv.prefix_hash(text[stay].reshape(-1))
            at_text = np.arange(len(stay)) * length
            h = tv.window_hashes(prefix, at_text, at_text + length, at_text)
            send(rk[r][stay], place[stay], np.ones(len(stay), np.uint8), ids[r][stay], h, begin[stay])
        return pa.Table.from_batches([_batch(out, _CTX)])

    return fetch


# ------------------------------------------------------------------------------------------------------ transform
def bounded_order(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions sorted by their next `length` bytes, first-8-bytes class of each sorted position).

    The buffer is read as a circle. Ranks double in width: 8, 16, 32, ..., `length`.
    """
    n = len(data)
    padded = np.resize(data, n + 8)
    key = np.zeros(n, U)
    for i in range(8):
        key = (key << U(8)) | padded[i : i + n].astype(U)
    order = np.argsort(key)
    new = np.concatenate(([False], key[order][1:] != key[order][:-1]))
    eight = np.cumsum(new)
    rank = np.empty(n, np.int64)
    rank[order] = eight + 1
    width = 8
    while width < length:
        step = min(width, length - width)
        key = (rank.astype(U) << U(32)) | np.roll(rank, -step).astype(U)
        order = np.argsort(key)
        new = np.concatenate(([False], key[order][1:] != key[order][:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) + 1
        width += step
    return order, eight


def common_prefix_classes(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(order, class): sorted positions and, for each, a class number; equal numbers share `length` bytes.

    The transform holds the byte before each sorted suffix. Starting from the intervals of 8-byte prefixes (read off
    the sort keys), every interval whose right boundary is new is extended backwards by the bytes that precede it;
    the images' boundaries, if new, have common prefix length = level and are extended at the next level. The
    expansion ends when the level reaches `length`.
    """
    n = len(data)
    order, eight = bounded_order(data, length)
    before = data[order - 1]  # the transform
    # LF mapping: where the suffix that starts one byte earlier stands, up to its place inside its own interval
    by_byte = np.argsort(before, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by_byte] = np.arange(n)
    same = np.concatenate(([False], before[1:] == before[:-1]))
    run_of = np.cumsum(~same) - 1
    run_first = np.flatnonzero(~same)
    run_last = np.concatenate((run_first[1:], [n])) - 1
    reached = np.zeros(n + 1, bool)  # boundary before sorted place i
    left = np.flatnonzero(np.concatenate(([True], eight[1:] != eight[:-1])))
    reached[left] = True
    reached[n] = True
    right = np.concatenate((left[1:], [n]))
    for _ in range(8, length):
        if not len(left):
            break
        # the runs of equal preceding bytes within each interval
        lo, hi = run_of[left], run_of[right - 1]
        many = hi - lo + 1
        of = np.repeat(np.arange(len(left)), many)
        run = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + lo[of]
        start = np.maximum(run_first[run], left[of])
        stop = np.minimum(run_last[run], right[of] - 1)
        if len(of) > len(left):  # several runs of one byte in an interval: first start and last stop
            key = of * 256 + before[start]
            by = np.argsort(key, kind="stable")
            head = np.concatenate(([True], key[by][1:] != key[by][:-1]))
            first = np.flatnonzero(head)
            end = np.concatenate((first[1:], [len(by)])) - 1
            start, stop = start[by[first]], stop[by[end]]
        new_left, new_right = lf[start], lf[stop] + 1
        fresh = ~reached[new_right] | ~reached[new_left]
        new_left, new_right = new_left[fresh], new_right[fresh]
        reached[new_left] = True
        reached[new_right] = True
        left, right = new_left, new_right
    return order, np.cumsum(reached[:n]) - 1


def _blocks(h: np.ndarray, size: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Row numbers (sorted by anchor) of whole anchors, up to `most` bytes together; a larger anchor stands alone."""
    order = np.argsort(h, kind="stable")
    hh = h[order]
    first = np.flatnonzero(np.concatenate(([True], hh[1:] != hh[:-1])))
    each = np.add.reduceat(size[order], first)
    bounds = np.append(first, len(order))
    begin, held = 0, 0
    for g in range(len(first)):
        if held and held + each[g] > most:
            yield order[bounds[begin] : bounds[g]]
            begin, held = g, 0
        held += each[g]
    if len(first):
        yield order[bounds[begin] :]


def covered_windows(data: np.ndarray, off: np.ndarray, count: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For runs of bytes (offsets, windows, document): a mask over all windows, in order, that a smaller id covers."""
    first = np.cumsum(count) - count
    of = np.repeat(np.arange(len(count)), count)
    at = off[of] + np.arange(count.sum()) - first[of]
    order, cls = common_prefix_classes(data, length)
    of_place = np.full(len(data), -1, np.int64)
    of_place[at] = np.arange(len(at))
    w = of_place[order]
    has = w >= 0
    w, cls = w[has], cls[has]
    new = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1])))
    least = np.minimum.reduceat(ids[of[w]], new)
    least = np.repeat(least, np.diff(np.append(new, len(w))))
    out = np.zeros(len(at), bool)
    out[w] = ids[of[w]] > least
    return out


def _expand(buckets: int, length: int, most: int):
    """Windows covered in the blocks of a group of anchors, and those that are known to be."""

    def expand(table: pa.Table) -> pa.Table:
        known = table.filter(pc.is_valid(table["bucket"]))
        out = [(b, COVERED, blob) for b, blob in zip(known["bucket"].to_pylist(), known["meta"].to_pylist(), strict=True)]
        sent = table.filter(pc.is_null(table["bucket"]))
        found = [unpack(b, rk=np.int64, at=np.uint32, n=np.uint8, id=np.int64, h=U) for b in sent["meta"].to_pylist()]
        if not found:
            return _marks(out)
        rk, at, n, ids, h = (np.concatenate([f[k] for f in found]) for k in ("rk", "at", "n", "id", "h"))
        data = np.frombuffer(b"".join(sent["bytes"].to_pylist()), np.uint8)
        n = n.astype(np.int64)
        size = n + length - 1
        off = np.cumsum(size) - size
        for rows in _blocks(h, size, most):
            inner = np.cumsum(size[rows]) - size[rows]
            index = np.arange(size[rows].sum()) + np.repeat(off[rows] - inner, size[rows])
            mask = covered_windows(data[index], inner, n[rows], ids[rows], length)
            of = np.repeat(np.arange(len(rows)), n[rows])[mask]
            place = at[rows][of] + (np.flatnonzero(mask) - (np.cumsum(n[rows]) - n[rows])[of])
            out += [(b, COVERED, blob) for b, blob in _marks_of(rk[rows][of], place, np.ones(len(of), np.int64), buckets)]
        tv.tidy()
        return _marks(out)

    return expand


# ---------------------------------------------------------------------------------------------------------- apply
_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string"


def _apply(length: int, with_text: bool, carried: list[str]):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_text", *carried]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]

    def apply(docs: pa.Table, marks: pa.Table) -> pa.Table:
        if not len(docs):
            return pa.Table.from_arrays([*[pa.array([], t) for t in types], *[docs[c] for c in carried]], names=names)
        data, off = tv.buffers(docs["text"])
        size = np.diff(off)
        gone = np.zeros(len(data) + 1, np.int32)
        keys = docs["rk"].to_numpy()
        order = np.argsort(keys, kind="stable")
        for blob in marks["blob"].to_pylist():
            m = unpack(blob, rk=np.int64, at=np.uint32, n=np.uint32)
            low = np.searchsorted(keys[order], m["rk"], side="left")
            high = np.searchsorted(keys[order], m["rk"], side="right")
            for nth in range(int((high - low).max(initial=0))):  # more than once only for rows repeated in full
                has = low + nth < high
                start = off[order[low[has] + nth]] + m["at"][has]
                np.add.at(gone, start, 1)
                np.subtract.at(gone, start + m["n"][has].astype(np.int64) - 1 + length, 1)
        gone = np.cumsum(gone[:-1]) > 0
        removed = np.concatenate(([0], np.cumsum(gone)))
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        starts = off[:-1][size > 0]
        opens[starts] = gone[starts]
        spans = np.concatenate(([0], np.cumsum(opens)))
        kept, kept_off = data[~gone], off - removed[off]
        kept_arr = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(kept_off.astype(np.int64).tobytes()), pa.py_buffer(kept.tobytes())])
        if with_text:  # a character goes only if all its bytes go
            lead = (data & 0xC0) != 0x80
            char = np.cumsum(lead) - 1
            stays = np.zeros(int(char[-1]) + 1 if len(char) else 0, bool)
            stays[char[~gone]] = True
            stay = stays[char] if len(char) else np.zeros(0, bool)
            text_off = np.concatenate(([0], np.cumsum(stay)))[off]
            text = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(text_off.astype(np.int64).tobytes()), pa.py_buffer(data[stay].tobytes())])
            kept_arr = pa.nulls(len(size), pa.binary())
        else:
            text, kept_arr = pa.nulls(len(size), pa.string()), kept_arr.cast(pa.binary())
        counted = [pa.array(size), pa.array(removed[off[1:]] - removed[off[:-1]]), pa.array(spans[off[1:]] - spans[off[:-1]])]
        return pa.Table.from_arrays([docs["doc_id"], *counted, kept_arr, text.cast(pa.string()), *[docs[c] for c in carried]], names=names)

    return apply


def keyed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, rk (a key of the row's id and text) and the carried columns as carried_0, carried_1, ..."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *[docs[c].alias(f"carried_{i}") for i, c in enumerate(carry)])
    rows = rows.withColumn("rk", F.xxhash64(F.coalesce("doc_id", F.lit(LAST_ID)), F.coalesce("text", F.lit(""))))
    return rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST_ID)))


def _met(rows: DataFrame, parts: int, buckets: int, length: int, gram: int, block_bytes: int) -> DataFrame:
    sent = rows.select("doc_id", "text", "rk").where(F.octet_length("text") >= length)
    sent = sent.mapInArrow(_send_runs(parts, buckets, length, gram), "part int, bucket int, docs binary, runs binary")
    return cut(sent.groupBy("part").applyInArrow(_meet(buckets, length, block_bytes), _MARKS_DDL))


def _expanded(bucketed: DataFrame, met: DataFrame, parts: int, buckets: int, length: int, block_bytes: int) -> DataFrame:
    asked = met.where(F.col("kind") != COVERED)
    long = bucketed.select("bucket", "rk", "doc_id", "text").where(F.octet_length("text") >= length)
    pieces = long.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_fetch(parts, buckets, length), "part int, bucket int, meta binary, bytes binary")
    return cut(pieces.groupBy("part").applyInArrow(_expand(buckets, length, block_bytes), _MARKS_DDL))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False, carry: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: n_bytes, n_removed, n_spans, kept (the remaining bytes), and the carried columns.

    With with_text the remaining text comes as the string kept_text instead, in which a character is left out only
    if all its bytes are.
    """
    spark = docs.sparkSession
    rows = keyed(docs, carry)
    n_bytes = text_bytes(rows)
    buckets, parts = n_groups(n_bytes), n_groups(n_bytes)
    met = _met(rows, parts, buckets, length, gram, block_bytes)
    release(spark)
    bucketed = rows.withColumn("bucket", F.pmod(_unsigned_mod("rk", buckets), F.lit(buckets)).cast("int"))
    more = _expanded(bucketed, met, parts, buckets, length, block_bytes)
    release(spark)
    marks = met.where(F.col("kind") == COVERED).unionByName(more).select("bucket", "blob")
    carried = [f"carried_{i}" for i in range(len(carry))]
    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried)
    out = bucketed.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(_apply(length, with_text, carried), f"{_OUT}, {types}" if types else _OUT)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != LAST_ID, F.col("doc_id")))


def _unsigned_mod(column: str, n: int):
    """The column as an unsigned 64-bit number, modulo n."""
    high = F.shiftrightunsigned(column, 1)
    return F.pmod(F.pmod(high, F.lit(n)) * 2 + F.col(column).bitwiseAND(F.lit(1)), F.lit(n))


#: The rows of op5 in SQL: all windows of all texts, in hexadecimal digits.
SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), parts AS (
  SELECT doc_id, k * 1000 AS base, substr(h, 2000 * k + 1, 2098) AS part FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2000 + 1)) AS k FROM d)
), w AS (
  SELECT doc_id, base + p AS p, substr(part, 2 * p + 1, 100) AS g FROM (SELECT *, unnest(range(0, least(1000, greatest(0, len(part) // 2 - 49)))) AS p FROM parts)
), least_of AS (
  SELECT g, min(doc_id) AS m FROM w GROUP BY g
), hit AS (
  SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS step FROM w JOIN least_of USING (g) WHERE doc_id > m
), spans AS (
  SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM (SELECT doc_id, p, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM hit) GROUP BY doc_id, island
), cuts AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS low, a AS high FROM spans UNION ALL SELECT doc_id, coalesce(max(b), 0), max(len(h) // 2) FROM d LEFT JOIN spans USING (doc_id) GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * low + 1, 2 * (high - low)), '' ORDER BY low) AS hk FROM cuts JOIN d USING (doc_id) GROUP BY doc_id
), counted AS (
  SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM spans GROUP BY doc_id
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(hk)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN counted USING (doc_id)
"""
