"""Removal of byte strings that an earlier document holds already, by distributed suffix sorting.

Every 50-byte window has a minimizer: the leftmost of its 20-byte grams with the least hash. Equal windows have equal
minimizers, so windows meet by minimizer and never by pairs of documents:

1. Each task reduces its texts to runs of windows with one minimizer and learns which minimizers two documents share;
   those that it saw in one document go, once a task, to the minimizer's bucket, which answers the same for the corpus.
2. Texts move to blocks, with the shared minimizers of each. A block cuts the text under shared minimizers into fragments
   of at most 80 bytes and sends each distinct one, with its smallest document, to the minimizer's bucket.
3. A bucket trims fragments of one minimizer to what two of them can have in common, suffix-sorts the distinct remains with
   the grouping construction, and gives every window the smallest document that holds it.
4. Blocks mark the bytes of windows that a smaller document holds.

Everything is keyed by hashes of text, each side of a bucket or block is bounded by its share of the corpus, copies are
collapsed before they are sent, and the only thing collected is one sum of lengths. Where there are more buckets or blocks
than MOST, what is sent to them goes to MOST ranges first and is dealt out from there, so that a row still holds many numbers;
tasks are MOST at most, each taking its buckets or blocks one after another."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mentionforge.llm.common import free_names, table
from mentionforge.llm.suffix_array import suffix_array
from mentionforge.session import give_back, map_in_arrow, ship, spread

WIDTH, GRAM = 50, 20
REACH = WIDTH - GRAM + 1
SEGMENT, FLUSH_BYTES, FLUSH_DOCS = (1 << 20) - 64, 16 << 20, 60_000
BUCKET_RUNS, BLOCK_BYTES = 1_000_000, 8_000_000
#: Ranges, tasks of a stage, and numbers that a task holds while it deals out a range.
MOST, DEALT = 16_384, 1_000_000
_U = np.uint64
_KEY = (1 << 32) - 1
_PLACE = _U((1 << 20) - 1)
_P = 0x9E3779B97F4A7C15


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    h1 = b.astype(_U) + _U(1)
    p, h, step, by = _P, h1, 1, {}
    while step * 2 <= GRAM:
        by[step] = (h, p)
        h = h[:-step] * _U(p) + h[step:]
        p, step = p * p % (1 << 64), step * 2
    left, done = GRAM - step, step
    for q in (8, 4, 2, 1):
        if left >= q:
            h = h[: len(h) - q] * _U(by[q][1]) + by[q][0][done : done + len(h) - q]
            left, done = left - q, done + q
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    return h


def minimizer_runs(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, minimizer position, first window, last window, minimizer hash) of every run of windows inside documents;
    ends: where each document of buf ends. Works through buf by segments, so memory does not follow a long text."""
    out = []
    for a in range(0, len(buf) - WIDTH + 1, SEGMENT):
        sub = buf[a : a + SEGMENT + WIDTH - 1]
        h = _gram_hashes(sub)
        low, step = (h & ~_PLACE) | np.arange(len(h), dtype=_U), 1  # the least of these is the leftmost of the least hashes
        while step < REACH:
            d = min(step, REACH - step)
            low = np.minimum(low[d:], low[:-d])
            step += d
        at = (low & _PLACE).astype(np.int32)
        ok = np.ones(len(at), bool)
        for e in ends[np.searchsorted(ends, a, "right") : np.searchsorted(ends, a + len(at) + WIDTH, "right")]:
            ok[max(0, e - WIDTH + 1 - a) : max(0, e - a)] = False
        first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (ok[1:] != ok[:-1])])
        last = np.r_[first[1:], len(at)] - 1
        keep = ok[first]
        first, last = first[keep], last[keep]
        p = at[first]
        out.append((np.searchsorted(ends, a + first, "right"), a + p.astype(np.int64), a + first, a + last, h[p]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 4 + (np.empty(0, _U),)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts], dtype=np.int64)


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _split(kind: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, places) by the values of kind."""
    order = np.argsort(kind, kind="stable")
    cuts = np.flatnonzero(np.diff(kind[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(kind[part[0]]), part


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


#: Numbers that rise are stored as differences, which the shuffle's compression takes to a byte or two.
_RUNS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary()), ("many", pa.binary())])
_RUNS_DDL = "bucket bigint, block bigint, docs binary, counts binary, keys binary, many binary"
_SHARED = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_SHARED_DDL = "block bigint, kind int, a binary, b binary, c binary"


def _thin(rising: np.ndarray) -> bytes:
    return np.diff(rising, prepend=rising.dtype.type(0)).tobytes()


def _full(thin: bytes, kind=np.int64) -> np.ndarray:
    return np.cumsum(np.frombuffer(thin, kind), dtype=kind)


def _by_block(docs: np.ndarray, keys: np.ndarray, blocks: int, ranges: int | None = None) -> Iterator[tuple]:
    """(block, documents in order, keys) of pairs; by ranges of blocks if there are more blocks than ranges."""
    order = np.argsort(docs, kind="stable")
    docs, keys = docs[order], keys[order]
    kind = np.mod(docs, blocks)
    for block, at in _split(kind if ranges is None or blocks <= ranges else kind % ranges):
        yield block, _thin(docs[at]), keys[at].astype("<u4").tobytes()


def _by_bucket(docs: np.ndarray, fp: np.ndarray, many: np.ndarray, buckets: int, ranges: int) -> Iterator[tuple]:
    """Rows of _RUNS; by ranges of buckets, with whole hashes, if there are more buckets than ranges."""
    order = np.argsort(docs, kind="stable")
    docs, fp, many = docs[order], fp[order], many[order]
    kind, whole = ((fp >> _U(40)) % _U(buckets)).astype(np.int64), buckets > ranges
    for bucket, at in _split(kind % ranges if whole else kind):
        used, n = np.unique(docs[at], return_counts=True)
        keys = fp[at].astype("<u8") if whole else (fp[at] & _U(_KEY)).astype("<u4")
        yield bucket, None, _thin(used), n.astype("<u4").tobytes(), keys.tobytes(), np.packbits(many[at]).tobytes()


def _deal_runs(buckets: int, most: int):
    """Rows of ranges, sorted by them, to rows of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            docs, fp, many = (np.concatenate(x) for x in zip(*held, strict=True))
            return _batch(_RUNS, list(_by_bucket(docs, fp, many, buckets, buckets)))

        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] is not None:
                    yield _batch(_RUNS, [tuple(r.values())])
                    continue
                docs, fp, many = _unpacked(r, "<u8")
                held.append((docs, fp.astype(_U), many))
                size += len(docs)
                if size >= most:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


def _unpacked(row: dict, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, keys, whether the sender saw the key in several documents) of a row of _RUNS."""
    keys = np.frombuffer(row["keys"], kind)
    many = np.unpackbits(np.frombuffer(row["many"], np.uint8), count=len(keys)).astype(bool)
    return np.repeat(_full(row["docs"]), np.frombuffer(row["counts"], "<u4")), keys, many


def _deal_pairs(blocks: int, most: int):
    """Rows (range of blocks, 0, docs, keys), sorted by range, to rows of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            docs, keys = (np.concatenate(x) for x in zip(*held, strict=True))
            return _batch(_SHARED, [(b, 0, d, k, None) for b, d, k in _by_block(docs, keys, blocks)])

        for batch in batches:
            for r in batch.to_pylist():
                held.append((_full(r["a"]), np.frombuffer(r["b"], "<u4")))
                size += len(held[-1][0])
                if size >= most:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


def _reduce_texts(buckets: int, blocks: int, ranges: int):
    """Rows (doc_id, text) to rows for buckets (block null) and rows of pairs known to be shared (block set)."""

    def flush(docs: list[int], runs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        names = np.array(docs, np.int64)
        ids, place = np.unique(names, return_inverse=True)
        doc = place[np.concatenate([r[0] for r in runs])].astype(np.int64)
        fp = np.concatenate([r[1] for r in runs])
        order = np.lexsort((doc, fp))
        doc, fp = doc[order], fp[order]
        new = np.r_[True, (fp[1:] != fp[:-1]) | (doc[1:] != doc[:-1])]
        doc, fp = doc[new], fp[new]
        start = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]])
        count = np.diff(np.r_[start, len(fp)])
        shared = np.repeat(count > 1, count)
        rows = [(k % min(buckets, ranges), b, d, None, x, None) for k, (b, d, x) in enumerate(_by_block(ids[doc[shared]], fp[shared] & _U(_KEY), blocks, ranges))]
        if rows:
            yield _batch(_RUNS, rows)
        yield _batch(_RUNS, list(_by_bucket(ids[doc[start]], fp[start], count > 1, buckets, ranges)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, runs, size, texts, waiting = [], [], 0, [], 0

        def work():
            nonlocal texts, waiting
            buf, ends = _joined(texts)
            doc, _, _, _, fp = minimizer_runs(buf, ends)
            runs.append((doc + len(docs) - len(texts), fp))
            texts, waiting = [], 0

        for batch in batches:
            for d, t in zip(batch.column(0), batch.column(1), strict=True):
                t = _utf8(t.as_py())
                if len(t) < WIDTH:
                    continue
                docs.append(d.as_py())
                texts.append(t)
                waiting += len(t)
                size += len(t)
                if waiting >= SEGMENT:
                    work()
                if size >= FLUSH_BYTES or len(docs) >= FLUSH_DOCS:
                    if texts:
                        work()
                    yield from flush(docs, runs)
                    docs, runs, size = [], [], 0
        if texts:
            work()
        if docs:
            yield from flush(docs, runs)

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows by the value of their first column, which they are sorted by."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            k = row[batch.schema.names[0]]
            if k != key and rows:
                yield key, rows
                rows = []
            key = k
            rows.append(row)
    if rows:
        yield key, rows


def _answer_buckets(blocks: int, ranges: int):
    """Bucket rows to rows (block, 0, docs, keys) of the minimizers that two documents share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches):
            known = [(r["block"], 0, r["docs"], r["keys"], None) for r in rows if r["block"] is not None]
            if known:
                yield _batch(_SHARED, known)
            docs, keys, many = [], [], []
            for r in (r for r in rows if r["block"] is None):
                for held, x in zip((docs, keys, many), _unpacked(r, "<u4"), strict=True):
                    held.append(x)
            if not docs:
                continue
            docs, keys, many = np.concatenate(docs), np.concatenate(keys), np.concatenate(many)
            order = np.argsort(keys, kind="stable")
            docs, keys, many = docs[order], keys[order], many[order]
            start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            count = np.diff(np.r_[start, len(keys)])
            shared = (np.minimum.reduceat(docs, start) != np.maximum.reduceat(docs, start)) | np.maximum.reduceat(many, start)
            tell = np.repeat(shared, count) & ~many
            out = [(b, 0, d, k, None) for b, d, k in _by_block(docs[tell], keys[tell], blocks, ranges)]
            if out:
                yield _batch(_SHARED, out)

    return run


class _Block:
    """The texts of a block in a fixed order, and the fragments under its shared minimizers; both uses of a block's rows
    build the same one."""

    def __init__(self, texts: pa.Table, pairs: list[tuple[bytes, bytes]]):
        rows = sorted(zip(texts.column("doc_id").to_pylist(), map(_utf8, texts.column("text").to_pylist()), range(texts.num_rows), strict=True))
        self.order = [r[2] for r in rows]
        self.docs = np.array([r[0] for r in rows], np.int64)
        self.texts = [r[1] for r in rows]
        self.buf, self.ends = _joined(self.texts)
        self.fragments: dict[bytes, int] = {}
        self.doc = self.first = self.last = self.id = np.empty(0, np.int64)
        if not pairs or not rows:
            return
        ids, place = np.unique(self.docs, return_inverse=True)
        told = np.concatenate([_full(d) for d, _ in pairs])
        keys = np.concatenate([np.frombuffer(k, "<u4") for _, k in pairs])
        told = np.unique(np.searchsorted(ids, told).astype(_U) << _U(32) | keys.astype(_U))
        doc, p, first, last, fp = minimizer_runs(self.buf, self.ends)
        own = place[doc].astype(_U) << _U(32) | fp & _U(_KEY)
        at = np.minimum(np.searchsorted(told, own), len(told) - 1)
        hit = np.flatnonzero(told[at] == own) if len(told) else np.empty(0, np.int64)
        self.doc, self.first, self.last, fp = doc[hit], first[hit], last[hit], fp[hit]
        whole, fragments = self.buf.tobytes(), self.fragments
        self.id = np.fromiter((fragments.setdefault(whole[a : b + WIDTH], len(fragments)) for a, b in zip(self.first.tolist(), self.last.tolist(), strict=True)), np.int64, len(hit))
        _, one = np.unique(self.id, return_index=True)
        self.fp, self.at, self.smallest = fp[one], (p[hit] - self.first)[one], self.docs[self.doc[one]]


_FRAGMENTS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("ids", pa.binary()), ("at", pa.binary()), ("docs", pa.binary()), ("lens", pa.binary()), ("text", pa.binary())])
_FRAGMENTS_DDL = "bucket bigint, block bigint, ids binary, at binary, docs binary, lens binary, text binary"


def _cut_fragments(buckets: int):
    def run(texts: pa.Table, shared: pa.Table) -> pa.Table:
        if not texts.num_rows or not shared.num_rows:
            return _FRAGMENTS.empty_table()
        b = _Block(texts, list(zip(shared.column("a").to_pylist(), shared.column("b").to_pylist(), strict=True)))
        if not b.fragments:
            return _FRAGMENTS.empty_table()
        block, text, rows = texts.column("_block")[0].as_py(), list(b.fragments), []
        for bucket, at in _split((b.fp % _U(buckets)).astype(np.int64)):
            parts = [text[k] for k in at.tolist()]
            rows.append((bucket, block, _thin(at.astype("<u4")), b.at[at].astype(np.uint8).tobytes(), _thin(b.smallest[at]), np.array([len(x) for x in parts], np.uint8).tobytes(), b"".join(parts)))
        out = pa.Table.from_batches([_batch(_FRAGMENTS, rows)])
        del b, text, rows
        give_back()
        return out

    return run


def _common(keys: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each padded row, the longest beginning that it shares with another row of its key."""
    order = np.lexsort((rows.view(f"S{rows.shape[1]}").ravel(), keys))
    r, n, k = rows[order], lengths[order], keys[order]
    differ = r[1:] != r[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    lcp = np.where(k[1:] == k[:-1], np.minimum(lcp, np.minimum(n[1:], n[:-1])), 0)
    out = np.empty(len(rows), np.int64)
    out[order] = np.maximum(np.r_[0, lcp], np.r_[lcp, 0])
    return out


def _smallest_by_window(strings: list[bytes], docs: list[int]) -> list[list[int]]:
    """For each string, the smallest document among all strings that hold the window at each of its starts."""
    joint = b"\xff".join(strings)  # no UTF-8 text holds this byte
    owner = np.repeat(np.arange(len(strings)), [len(s) + 1 for s in strings])
    starts = np.cumsum([0] + [len(s) + 1 for s in strings])
    out = [[d] * (len(s) - WIDTH + 1) for s, d in zip(strings, docs, strict=True)]
    sizes = [len(s) for s in strings]
    run: list[tuple[int, int]] = []
    last = b""

    def close():
        if len(run) > 1:
            least = min(docs[w] for w, _ in run)
            for w, o in run:
                out[w][o] = least

    for s in suffix_array(joint):
        w = int(owner[s])
        offset = s - int(starts[w])
        if offset + WIDTH > sizes[w]:
            continue
        window = joint[s : s + WIDTH]
        if window != last:
            close()
            run, last = [], window
        run.append((w, offset))
    close()
    return out


def _solve_bucket(rows: list[dict]) -> Iterator[tuple]:
    """Fragments of a bucket to rows (block, fragments all of whose windows a document before the block's own holds, and
    (fragment, first window, last window) of those with some)."""
    block = np.concatenate([np.full(len(r["lens"]), r["block"], np.int64) for r in rows])
    ids = np.concatenate([_full(r["ids"], "<u4") for r in rows])
    at = np.concatenate([np.frombuffer(r["at"], np.uint8) for r in rows]).astype(np.int64)
    doc = np.concatenate([_full(r["docs"]) for r in rows])
    texts: list[bytes] = []
    for r in rows:
        cuts = np.cumsum(np.frombuffer(r["lens"], np.uint8), dtype=np.int64).tolist()
        texts.extend(r["text"][a:b] for a, b in zip([0, *cuts], cuts, strict=False))
    known: dict[bytes, int] = {}
    which = np.fromiter((known.setdefault(t, len(known)) for t in texts), np.int64, len(texts))
    n = len(known)
    own = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(own, which, doc)
    _, one = np.unique(which, return_index=True)
    texts, at = list(known), at[one]
    grams: dict[bytes, int] = {}
    group = np.fromiter((grams.setdefault(t[p : p + GRAM], len(grams)) for t, p in zip(texts, at.tolist(), strict=True)), np.int64, n)
    count = np.bincount(group)
    many = np.flatnonzero(count[group] > 1)
    answers: dict[int, np.ndarray] = {}
    if len(many):
        size = np.array([len(texts[k]) for k in many])
        left, right = np.zeros((len(many), REACH - 1), np.uint8), np.zeros((len(many), WIDTH - GRAM), np.uint8)
        for j, k in enumerate(many.tolist()):
            t, p = texts[k], int(at[k])
            before, after = t[:p][::-1], t[p + GRAM :]
            left[j, : len(before)] = np.frombuffer(before, np.uint8) + np.uint8(1)  # 0 is what rows are filled up with
            right[j, : len(after)] = np.frombuffer(after, np.uint8) + np.uint8(1)
        l = _common(group[many], left, at[many])  # noqa: E741
        r = _common(group[many], right, size - GRAM - at[many])
        trimmed: dict[tuple[int, bytes], int] = {}
        holders: list[tuple[int, int, int]] = []
        for j, k in enumerate(many.tolist()):
            if l[j] + GRAM + r[j] >= WIDTH:
                a = int(at[k] - l[j])
                t = texts[k][a : int(at[k]) + GRAM + int(r[j])]
                holders.append((k, a, trimmed.setdefault((int(group[k]), t), len(trimmed))))
        least = np.full(len(trimmed), np.iinfo(np.int64).max)
        if holders:
            np.minimum.at(least, [h[2] for h in holders], own[[h[0] for h in holders]])
        strings = [t for _, t in trimmed]
        per_group = np.bincount([g for g, _ in trimmed], minlength=1) if trimmed else np.zeros(1, int)
        mixed = [x for x, (g, _) in enumerate(trimmed) if per_group[g] > 1]
        solved = dict(zip(mixed, _smallest_by_window([strings[x] for x in mixed], least[mixed].tolist()) if mixed else [], strict=True))
        for k, a, x in holders:
            m = np.full(len(texts[k]) - WIDTH + 1, own[k])
            found = solved.get(x)
            width = len(strings[x]) - WIDTH + 1
            m[a : a + width] = np.minimum(m[a : a + width], found if found is not None else least[x])
            if (m != own[k]).any():
                answers[k] = m
    least_of = np.array([answers[k].max() if k in answers else own[k] for k in range(n)]) if answers else own
    whole = least_of[which] < doc
    partly: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for x in np.flatnonzero(~whole & np.isin(which, list(answers))).tolist() if answers else ():
        edge = np.flatnonzero(np.diff(np.r_[False, answers[which[x]] < doc[x], False].astype(np.int8)))
        for first, end in edge.reshape(-1, 2).tolist():
            partly[int(block[x])].append((int(ids[x]), first, end - 1))
    for b, places in _split(block):
        all_of, some = np.sort(ids[places[whole[places]]]), np.array(partly.get(b, ()), np.int64).reshape(-1, 3)
        if len(all_of) or len(some):
            yield b, 1, _thin(all_of), some[:, 0].astype("<u4").tobytes(), some[:, 1:].astype(np.uint8).tobytes()


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in _grouped(batches):
        out = list(_solve_bucket(rows))
        if out:
            yield _batch(_SHARED, out)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_OUT_DDL = "_bytes bigint, _spans array<struct<start:bigint,end:bigint>>, _kept binary"


def _mark(digest: bool):
    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        rows = told.to_pylist()
        b = _Block(texts, [(r["a"], r["b"]) for r in rows if r["kind"] == 0])
        cover = np.zeros(len(b.buf) + 1, np.int32)

        def mark(first, last):
            np.add.at(cover, first, 1)
            np.add.at(cover, last + WIDTH, -1)

        if len(b.id):
            answers = [r for r in rows if r["kind"] == 1]
            whole = np.zeros(len(b.fragments), bool)
            for r in answers:
                whole[_full(r["a"], "<u4")] = True
            later = whole[b.id] | (b.docs[b.doc] > b.smallest[b.id])
            mark(b.first[later], b.last[later])
            frag = np.concatenate([np.empty(0, "<u4"), *(np.frombuffer(r["b"], "<u4") for r in answers)]).astype(np.int64)
            some = np.concatenate([np.empty((0, 2), np.uint8), *(np.frombuffer(r["c"], np.uint8).reshape(-1, 2) for r in answers)]).astype(np.int64)
            order = np.argsort(b.id, kind="stable")
            begin, end = (np.searchsorted(b.id[order], frag, side) for side in ("left", "right"))
            for f, (x, y), i, j in zip(frag.tolist(), some.tolist(), begin.tolist(), end.tolist(), strict=True):
                at = b.first[order[i:j]]
                mark(at + x, at + y)
        removed = np.cumsum(cover[:-1]) > 0
        sizes, spans, kept, a = [], [], [], 0
        for t in b.texts:
            m = removed[a : a + len(t)]
            a += len(t)
            edge = np.flatnonzero(np.diff(np.r_[False, m, False].astype(np.int8)))
            rest = np.frombuffer(t, np.uint8)[~m].tobytes() if len(edge) else t
            sizes.append(len(t))
            spans.append([{"start": x, "end": y} for x, y in edge.reshape(-1, 2).tolist()])
            kept.append(hashlib.sha256(rest).digest() if digest else rest.decode("utf-8", "ignore").encode() if len(edge) else rest)
        out = texts.drop_columns(["_block"]).take(pa.array(b.order, pa.int64()))
        for name, column in (("_bytes", pa.array(sizes, pa.int64())), ("_spans", pa.array(spans, _SPANS)), ("_kept", pa.array(kept, pa.binary()))):
            out = out.append_column(name, column)
        del b, cover, removed, spans, kept, sizes
        give_back()
        return out

    return run


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """The rows of docs (doc_id, text, and whatever else they hold) with _bytes, the text's length in bytes, _spans, its
    removed runs in bytes, and _kept, the remaining bytes, or their SHA-256 if digest, under the names that free_names gives
    where docs has such columns. Code points that a span cuts in two are left out of _kept (but not of its SHA-256).

    A byte goes if a 50-byte string over it also starts in a document with a smaller id. Null text counts as empty; rows
    without id neither lose bytes nor make others lose any; repeated rows of one id are judged alike and not against each
    other; an empty table gives an empty table."""
    ship(docs.sparkSession)
    columns = docs.columns
    docs = docs.toDF(*[c if c in ("doc_id", "text") else f"x{k}" for k, c in enumerate(columns)])  # no name meets those below
    known = docs.where("doc_id is not null")
    plain = known.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4, int(total * 2 / REACH / BUCKET_RUNS) + 1)
    blocks = max(4, int(total / BLOCK_BYTES) + 1) | 1
    dealt = lambda df, key, n: df.repartition(min(n, MOST), key).sortWithinPartitions(key)
    runs = map_in_arrow(plain, _reduce_texts(buckets, blocks, MOST), _RUNS_DDL)
    if buckets > MOST:
        runs = map_in_arrow(dealt(runs, "bucket", buckets), _deal_runs(buckets, DEALT), _RUNS_DDL)
    shared = map_in_arrow(dealt(runs, "bucket", buckets), _answer_buckets(blocks, MOST), _SHARED_DDL)
    if blocks > MOST:
        shared = map_in_arrow(dealt(shared, "block", blocks), _deal_pairs(blocks, DEALT), _SHARED_DDL)
    tasks = min(blocks, MOST)
    texts = known.withColumn("_block", F.pmod(F.col("doc_id").cast("long"), F.lit(blocks))).repartition(tasks, "_block")
    fragments = texts.groupBy("_block").cogroup(shared.repartition(tasks, "block").groupBy("block")).applyInArrow(_cut_fragments(buckets), _FRAGMENTS_DDL)
    solved = map_in_arrow(dealt(fragments, "bucket", buckets), _solve, _SHARED_DDL)
    told = shared.unionByName(solved).repartition(tasks, "block")
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(_OUT_DDL).fields])
    out = texts.groupBy("_block").cogroup(told.groupBy("block")).applyInArrow(_mark(digest), schema)
    whole = F.coalesce(F.encode("text", "utf-8"), F.lit(b""))
    rest = docs.where("doc_id is null").withColumns({"_bytes": F.length(whole).cast("long"), "_spans": F.array().cast("array<struct<start:bigint,end:bigint>>"), "_kept": F.unhex(F.sha2(whole, 256)) if digest else whole})
    return out.unionByName(rest).toDF(*columns, *free_names(columns, "_bytes", "_spans", "_kept"))


def op8(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), digest=True)
    removed = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", F.col("_bytes").alias("n_bytes"), removed.alias("n_removed"), F.size("_spans").cast("long").alias("n_spans"), F.lower(F.hex("_kept")).alias("kept_sha256"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes taken out of text, and n_chars, where there is one, set anew for those rows."""
    _, spans, kept = free_names(docs.columns, "_bytes", "_spans", "_kept")
    changed = F.size(spans) > 0
    out = remove_repeats(docs).withColumn("text", F.when(changed, F.decode(kept, "utf-8")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


#: Texts as hex, two characters a byte, so that string functions work on bytes.
OP8_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) s FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 49)) i FROM d)),
m AS (SELECT s, min(doc_id) m FROM w GROUP BY s),
c AS (SELECT doc_id, i, CASE WHEN lag(i) OVER k + 50 >= i THEN 0 ELSE 1 END b FROM w JOIN m USING (s) WHERE m < doc_id WINDOW k AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, sum(b) OVER (PARTITION BY doc_id ORDER BY i) g FROM c),
p AS (SELECT doc_id, min(i) a, max(i) + 50 e FROM r GROUP BY doc_id, g),
q AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) f FROM p),
t AS (SELECT doc_id, sum(e - a) x, count(*) n, max(e) z, string_agg(substr(h, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) y FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT n_bytes, coalesce(x, 0)::BIGINT n_removed, coalesce(n, 0)::BIGINT n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE y || substr(h, 2 * z + 1) END)) kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
