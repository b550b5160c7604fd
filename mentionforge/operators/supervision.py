"""Token supervision: which labels each token of a text may have, and which window learns it.

Intervals meet tokens by place alone. Tokens are in order and apart from each other, so where an interval begins and ends among
them are two counts, found by bisection, and what covers a token is a running maximum; nothing is joined by range. Spark brings
a text and its intervals together by one join on the document; a text is the unit of work."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionforge.session import map_in_arrow

#: Labels in the order of their bits.
LABELS = ("O", "B-SOFTWARE", "I-SOFTWARE", "B-VERSION", "I-VERSION")
ALL = (1 << len(LABELS)) - 1
#: For each kind of entity the bit of its first label, and for each field of a covered region the bits that it rules out.
FIRST = {"SOFTWARE": 1, "VERSION": 3}
RULED_OUT = {"software": 0b00110, "versions": 0b11000}
_WINDOWS = pa.list_(pa.struct([("window", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("allowed", pa.list_(pa.int8())), ("active", pa.list_(pa.bool_()))]))
_EXCLUDED = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string())]))
_DDL = "doc_id bigint, n_tokens bigint, windows array<struct<window:int,start:bigint,end:bigint,allowed:array<tinyint>,active:array<boolean>>>, exclusions array<struct<kind:string,start:bigint,end:bigint,reason:string>>"


def blank_separated(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"\S+", text)]


def _deepest(first: np.ndarray, last: np.ndarray, size: int, capacity: int, step: int) -> np.ndarray:
    """The window in which tokens first to last lie farthest from either edge, ties to the lower; -1 where none holds them all."""
    windows = max(-(-(size - capacity) // step), 0) + 1
    best, owner = np.full(len(first), -1), np.full(len(first), -1)
    for k in range(-(-capacity // step)):  # so many windows can hold a token
        w = first // step - k
        begin = w * step
        margin = np.minimum(first - begin, np.minimum(begin + capacity, size) - 1 - last)
        good = (w >= 0) & (w < windows) & (margin >= np.where(owner < 0, 0, best))  # the lower window comes later and wins ties
        best, owner = np.where(good, margin, best), np.where(good, w, owner)
    return owner


def supervise(starts: np.ndarray, ends: np.ndarray, regions: dict[str, np.ndarray], entities: list[tuple[int, int, str]], capacity: int, overlap: int):
    """allowed (bits), owner of each token, and excluded entities with a reason. starts, ends: tokens in order, apart from each other;
    regions: by field, rows (start, end) where all entities of that field are known; entities: distinct (start, end, kind)."""
    n, step = len(starts), capacity - overlap
    allowed = np.full(n, ALL)
    for field, spans in regions.items():
        spans = spans[np.argsort(spans[:, 0], kind="stable")]
        before = np.searchsorted(spans[:, 0], starts, "right")  # regions that begin by the token's start
        reach = np.r_[-1, np.maximum.accumulate(spans[:, 1])] if len(spans) else np.array([-1])
        allowed[(reach[before] >= ends) & (starts < ends)] &= ~RULED_OUT[field]
    owner = _deepest(np.arange(n), np.arange(n), n, capacity, step)
    if not entities:
        return allowed, owner, []
    entities = sorted(entities)
    s, e = np.array([x[0] for x in entities]), np.array([x[1] for x in entities])
    first, last = np.searchsorted(ends, s, "right"), np.searchsorted(starts, e, "left") - 1  # tokens that meet [s, e)
    ahead = np.r_[-1, np.maximum.accumulate(e)[:-1]]
    crossed = (ahead > s) | (np.r_[s[1:], np.iinfo(np.int64).max] < e)
    some = first <= last
    fits = some & (starts[np.minimum(first, n - 1)] == s) & (ends[np.maximum(last, 0)] == e) if n else some
    window = np.where(some, _deepest(first, last, n, capacity, step), -1)
    reasons = np.select([crossed, ~fits, window < 0], ["overlapping_entity", "token_boundary", "window_limit"], "")
    for k in np.flatnonzero(reasons == ""):
        bit = FIRST[entities[k][2]]
        allowed[first[k]] = 1 << bit
        allowed[first[k] + 1 : last[k] + 1] = 2 << bit
        owner[first[k] : last[k] + 1] = window[k]
    out = np.flatnonzero(reasons != "")
    for k in out:  # whatever else is said about their tokens
        allowed[first[k] : last[k] + 1] = ALL
    return allowed, owner, [{"kind": entities[k][2], "start": entities[k][0], "end": entities[k][1], "reason": str(reasons[k])} for k in out]


def _supervisor(capacity: int, overlap: int, offsets: Callable[[str], list[tuple[int, int]]]):
    step = capacity - overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for r in batch.slice(at, 256).to_pylist():
                    text, given = r["text"] or "", [(x["start"], x["end"], x["kind"]) for x in r["entities"] or ()]
                    places = np.array(offsets(text), np.int64).reshape(-1, 2)
                    regions = {f: np.array([(x["start"], x["end"]) for x in r["regions"] or () if x[f]], np.int64).reshape(-1, 2) for f in RULED_OUT}
                    odd = {x for x in given if x[2] not in FIRST or None in x or not 0 <= x[0] < x[1] <= len(text)}
                    allowed, owner, excluded = supervise(places[:, 0], places[:, 1], regions, list(set(given) - odd), capacity, overlap)
                    n = len(places)
                    windows = [{"window": w, "start": a, "end": (b := min(a + capacity, n)), "allowed": allowed[a:b].astype(np.int8), "active": (owner[a:b] == w) & (allowed[a:b] != ALL)} for w, a in enumerate(range(0, max(n - overlap, 1), step))] if n else []
                    excluded += [{"kind": k, "start": a, "end": b, "reason": "invalid_span"} for a, b, k in sorted(odd, key=repr)]
                    rows.append((r["doc_id"], n, windows, excluded))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), _WINDOWS, _EXCLUDED))], ["doc_id", "n_tokens", "windows", "exclusions"])

    return run


def token_supervision(docs: DataFrame, regions: DataFrame, entities: DataFrame, capacity: int = 480, overlap: int = 64, offsets: Callable[[str], list[tuple[int, int]]] = blank_separated) -> DataFrame:
    """(doc_id, n_tokens, windows, exclusions) of docs (doc_id, text).

    windows: (window, start, end in tokens, allowed, active), allowed the bits of LABELS that a token may have, active where this
    window is the one that learns the token and it has labels to choose from. regions (doc_id, start, end, software, versions)
    say where every entity of a kind is known: tokens inside have none of its labels unless an entity gives them one.
    entities (doc_id, start, end, kind): their tokens have the first label and then the others, and belong to the window in
    which all of them lie deepest. An entity is excluded, and its tokens may be anything, if another overlaps it, its ends are no
    tokens' ends, no window holds it whole, or (invalid_span) it has no place in the text or an unknown kind.

    A null text has no tokens; equal entities count once, null fields of regions are false; repeated rows of docs give theirs
    again, rows without id have no intervals; entities and regions of other documents are not read."""
    if not 0 <= overlap < capacity:
        raise ValueError("invalid window limits")
    gather = lambda df, name, *columns: df.groupBy("doc_id").agg(F.collect_set(F.struct(*columns)).alias(name))
    place = [F.col(c).cast("long").alias(c) for c in ("start", "end")]
    known = gather(regions.dropna(subset=["start", "end"]), "regions", *place, *[F.coalesce(f, F.lit(False)).alias(f) for f in RULED_OUT])
    named = gather(entities, "entities", *place, "kind")
    rows = docs.select("doc_id", "text").join(known, "doc_id", "left").join(named, "doc_id", "left")
    return map_in_arrow(rows.select(F.col("doc_id").cast("long"), "text", "regions", "entities"), _supervisor(capacity, overlap, offsets), _DDL)
