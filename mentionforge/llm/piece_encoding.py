"""SentencePiece encoding and decoding by a max-plus scan.

Encoding is a best path, and best paths compose: a chunk of text is a matrix over boundary states, chunks combine by the
max-plus product, which is associative, and each chunk is then traced back on its own between its two states. Giant texts are
split in chunks that become rows; a balanced product over a text's matrices fixes the state at every boundary.

A BPE model merges by rank and adds up nothing, yet its result is a best path too. A run of pieces is what merging gives if
and only if every two neighbours are what merging their joint text gives: merges inside a piece do not depend on what stands
around it until a merge crosses its edge, and the first one to cross would cross in the two neighbours' own text as well. So a
pair of neighbours scores 0 if merging leaves it as it is, and minus infinity if not; the only path of score 0 is the model's
result. A boundary state is then how many code points lie between the last cut and the boundary, and the piece before that
cut. For a unigram model the pieces' scores add up, and the piece before the cut makes no difference.

Where no piece holds the two characters around a place, none can reach across: texts fall into segments there, solved once
and remembered, and a chunk border at such a place has one state."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionforge.llm.common import saved, table
from mentionforge.session import map_in_arrow, spread

SPACE = "▁"
CHUNK, MEMORY = 16_384, 200_000
#: Segments up to this length are merged by a scan for the best pair each time, which is quadratic; longer ones are solved as paths.
MERGED = 64
NEVER = -(1 << 62)
_MODELS: dict = {}


class Pieces:
    """A vocabulary of a BPE or unigram model; `cuts` splits a text where no piece can reach across."""

    def __init__(self, pieces: list[tuple[str, float, str]], prefix: bool = True, merges: bool = True):
        """pieces: (text, score, kind) by id; kind is normal, byte or other. prefix: a space is put before the text. merges: a
        BPE model, else a unigram one, whose scores become integers, so that sums do not depend on their order."""
        normal = [(p, s) for p, s, kind in pieces if kind == "normal"]
        scale = 1 if merges or all(float(s).is_integer() for _, s in normal) else 1 << 16
        self.merges, self.prefix = merges, prefix
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == "normal"}
        self.score = {p: s if merges else round(s * scale) for p, s in normal}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.raw = [bytes([int(p[3:5], 16)]) if kind == "byte" else p.replace(SPACE, " ").encode() if kind == "normal" else b"" for p, _, kind in pieces]
        self.reach = max(map(len, self.ids), default=1)
        self.unknown = 0 if merges else min(self.score.values(), default=0) - 10 * scale
        self.inner = {a + b for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        space_leads = not any(b == SPACE and a != SPACE for a, b in self.inner)
        line = "" if any("\n" in p for p in self.inner) else "\n"  # a line feed that no piece joins stands alone
        ends = any(b in ".," and re.match(r"[^\W\d_]", a) for a, b in self.inner)
        plain = "" if ends else f"{SPACE}*[^\\W\\d_]+(?![^.,{SPACE}\n])|"  # a word up to its stop or comma
        self.cuts = re.compile((f"{line}|" if line else "") + f"{plain}{SPACE}*[^{SPACE}{line}]+|{SPACE}+") if space_leads else None
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple, bool] = {}

    def prepare(self, text: str) -> str:
        """Spaces become the mark; a mark is put in front of a text that is not empty."""
        t = text.replace(" ", SPACE)
        return SPACE + t if t and self.prefix else t

    def merged(self, text: str) -> list[str]:
        """What merging by rank leaves: the best pair first, the leftmost of equal ones."""
        score, parts = self.score, list(text)
        pairs = [score.get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := max(pairs)) > NEVER:
            k = pairs.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k:
                pairs[k - 1] = score.get(parts[k - 1] + parts[k], NEVER)
            if k < len(pairs):
                pairs[k] = score.get(parts[k] + parts[k + 1], NEVER)
        return parts

    def link(self, before: str | None, piece: str) -> int | None:
        """What `piece` adds to a path whose last piece is `before` (None: a place that nothing reaches across); None if it cannot
        follow."""
        if not self.merges:
            return self.score.get(piece, self.unknown)
        fits = self.pairs.get((before, piece))
        if fits is None:
            if len(self.pairs) > MEMORY:
                self.pairs.clear()
            fits = self.merged((before or "") + piece) == ([piece] if before is None else [before, piece])
            self.pairs[before, piece] = fits
        return 0 if fits else None

    def ending(self, text: str, end: int, least: int = 0) -> Iterator[tuple[int, str]]:
        """(start, piece) of the pieces that end at `end`, longest first; a character without a piece counts as one."""
        for a in range(max(least, end - self.reach), end):
            piece = text[a:end]
            if piece in self.score or a == end - 1:
                yield a, piece

    def solve(self, text: str, before: str | None = None, first_end: int = 0) -> list[str]:
        """Pieces of the best path behind `before`; ties go to the longer last piece. The first piece ends behind first_end."""
        n = len(text)
        value, last = [0] + [NEVER] * n, [before] + [None] * n
        for e in range(1, n + 1):
            for a, piece in self.ending(text, e):
                if value[a] == NEVER or (not a and e <= first_end):
                    continue
                w = self.link(last[a], piece)
                if w is not None and value[a] + w > value[e]:
                    value[e], last[e] = value[a] + w, piece
        out, e = [], n
        while e:
            out.append(last[e])
            e -= len(last[e])
        return out[::-1]

    def ids_of(self, parts: list[str]) -> list[int]:
        out = []
        for p in parts:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            else:
                out.extend([self.bytes.get(b, 0) for b in p.encode("utf-8", "surrogatepass")])
        return out

    def encode(self, text: str, before: str | None = None, first_end: int = 0) -> list[int]:
        """Ids of prepared text; segments between cuts are solved once and remembered up to a bound."""
        if before is not None or first_end or self.cuts is None:
            cut = self.next_cut(text, first_end)
            return [*self.ids_of(self.solve(text[:cut], before, first_end)), *(self.encode(text[cut:]) if cut < len(text) else ())]
        if len(self.known) > MEMORY:
            self.known, self.older = {}, self.known  # what is met again moves on
        known, older, out = self.known, self.older, []
        for s in self.cuts.findall(text):
            ids = known.get(s)
            if ids is None:
                ids = older.get(s) or tuple(self.ids_of(self.merged(s) if self.merges and len(s) <= MERGED else self.solve(s)))
                if len(s) <= MERGED:
                    known[s] = ids
            out += ids
        return out

    def next_cut(self, text: str, at: int) -> int:
        """The first place behind `at` that no piece reaches across; the end if there is none."""
        return next((i for i in range(at + 1, len(text)) if text[i - 1 : i + 1] not in self.inner), len(text))

    def last_cut(self, text: str, first: int) -> int:
        return next((i for i in range(len(text) - 1, first, -1) if text[i - 1 : i + 1] not in self.inner), first)

    def states(self, left: str) -> list[tuple[int, str | None]]:
        """The states that a border behind `left` (its last 2 * reach code points) may have: code points since the last cut, and
        the piece before it."""
        if not self.merges:
            return [(s, None) for s in range(min(self.reach, len(left)))]
        return [(s, piece) for s in range(min(self.reach, len(left))) for _, piece in self.ending(left, len(left) - s)]

    def matrix(self, left: str, chunk: str, enter: list[tuple[int, str | None]], leave: list[tuple[int, str | None]] | None) -> np.ndarray:
        """Best scores, up to a constant, from the states `enter` at the chunk's start to the states `leave` at its end; None: the one
        state of a border that no piece reaches across."""
        k, text = len(left), left + chunk
        n, at = len(text), {}

        def put(place, piece, v):
            held = at.setdefault(place, {})
            held[piece] = np.maximum(held[piece], v) if piece in held else v

        for i, (s, piece) in enumerate(enter):
            v = np.full(len(enter), NEVER, np.int64)
            v[i] = 0
            put(k - s, piece, v)
        start, cut = max(0, k - self.reach), self.next_cut(text, k)
        last = self.last_cut(text, cut)
        e = k
        while e < n:
            e += 1
            if cut < e <= last:  # what lies between cuts adds the same to every entry and decides nothing
                at = {last: {None: np.max(list(at.get(cut, {}).values()), axis=0)}}
                start = e = last
                continue
            for a, piece in self.ending(text, e, start):
                for before, v in at.get(a, {}).items():
                    w = self.link(before, piece)
                    if w is not None and (v > NEVER).any():
                        put(e, piece if self.merges else None, np.where(v > NEVER, v + w, NEVER))
            if e == cut < n and e in at:
                at = {e: {None: np.max(list(at[e].values()), axis=0)}}
                start = e
            at.pop(e - self.reach - 1 if n - e > self.reach else -1, None)
        none = np.full(len(enter), NEVER, np.int64)
        if leave is None:
            return np.max([none, *at.get(n, {}).values()], axis=0)[:, None]
        return np.stack([at.get(n - t, {}).get(piece, none) for t, piece in leave], axis=1)

    def decode(self, ids: list[int]) -> str:
        text = b"".join(self.raw[i] for i in ids).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; NEVER is its zero."""
    s = np.where((a[:, :, None] > NEVER) & (b[None] > NEVER), a[:, :, None] + np.where(b > NEVER, b, 0)[None], NEVER)
    return s.max(axis=1)


def boundary_states(matrices: list[np.ndarray]) -> list[int]:
    """The state at each of the len + 1 boundaries on the best path from state 0 to state 0: products up a balanced tree,
    then the middle state of every node on the way down."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        m = levels[-1]
        levels.append([product(m[i], m[i + 1]) if i + 1 < len(m) else m[i] for i in range(0, len(m), 2)])
    states = [0, 0]
    for m in reversed(levels[:-1]):
        out = [states[0]]
        for k in range(len(states) - 1):
            if 2 * k + 1 < len(m):
                a, b = m[2 * k][states[k]], m[2 * k + 1][:, states[k + 1]]
                out.append(int(np.where((a > NEVER) & (b > NEVER), a + np.where(b > NEVER, b, 0), NEVER).argmax()))
            out.append(states[k + 1])
        states = out
    return states


def chunks_of(model: Pieces, text: str, size: int = CHUNK) -> list[int]:
    """Boundaries of a prepared text: near every `size` chars, at a cut if the half chunk before has one."""
    at, out = 0, [0]
    while len(text) - at > size:
        end = at + size
        end = next((i for i in range(end, at + size // 2, -1) if text[i - 1 : i + 1] not in model.inner), end)
        out.append(end)
        at = end
    return [*out, len(text)] if text else [0, 0]


def load(path: str | None = None) -> Pieces:
    """A model file, kept per process. Models that put more into a text than spaces for marks, or know pieces of other kinds, are
    refused."""
    import public_tokenizers
    from sentencepiece import sentencepiece_model_pb2 as pb

    path = path or public_tokenizers.path("piece_bpe_32k.model")
    if path not in _MODELS:
        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        spec, kinds = m.normalizer_spec, {1: "normal", 2: "other", 3: "other", 6: "byte"}
        odd = spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix
        if odd or m.trainer_spec.model_type not in (1, 2) or any(p.type not in kinds for p in m.pieces):
            raise ValueError(f"not a model this encoder knows: {path}")
        _MODELS[path] = Pieces([(p.piece, p.score, kinds[p.type]) for p in m.pieces], spec.add_dummy_prefix, m.trainer_spec.model_type == 2)
    return _MODELS[path]


def _borders(model: Pieces, left: str, part: str, open_in: bool, open_out: bool) -> tuple[list, list | None]:
    """States at the two ends of a chunk; a border that is not open has one."""
    return (model.states(left) if open_in else [(0, None)], model.states((left + part)[-2 * model.reach :]) if open_out else None)


def _chunker(path: str | None, size: int):
    """Rows (doc_id, text_hash, row, text) to chunk rows; a text of one chunk is encoded at once, others get a matrix for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        if size < 2 * model.reach:
            raise ValueError(f"chunks of {size} are shorter than two pieces")
        for batch in batches:
            rows, held = [], 0
            for d, h, r, t in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                t = model.prepare(t or "")
                b = chunks_of(model, t, size)
                open_at = [x not in (0, len(t)) and t[x - 1 : x + 1] in model.inner for x in b]
                for k, (x, y) in enumerate(zip(b, b[1:], strict=False)):
                    if len(b) == 2:
                        rows.append((d, h, r, 0, 1, None, None, None, None, None, np.array(model.encode(t), "<u4").tobytes()))
                    else:
                        left = t[max(0, x - 2 * model.reach) : x] if open_at[k] else ""
                        enter, leave = _borders(model, left, t[x:y], open_at[k], open_at[k + 1])
                        m = model.matrix(left, t[x:y], enter, leave)
                        rows.append((d, h, r, k, len(b) - 1, m.tobytes(), m.shape[0], left, t[x:y], open_at[k + 1], None))
                    held += y - x
                if held > 1 << 20:
                    yield _rows(_CHUNKS, rows)
                    rows, held = [], 0
            yield _rows(_CHUNKS, rows)

    return run


_CHUNKS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("row", pa.int64()), ("chunk", pa.int32()), ("n_chunks", pa.int32()), ("matrix", pa.binary()), ("height", pa.int32()), ("left", pa.string()), ("part", pa.string()), ("open_out", pa.bool_()), ("ids", pa.binary())])
_CHUNKS_DDL = "doc_id bigint, text_hash bigint, row bigint, chunk int, n_chunks int, matrix binary, height int, left string, part string, open_out boolean, ids binary"
_STATES = pa.schema([("row", pa.int64()), ("chunk", pa.int32()), ("enter", pa.int32()), ("leave", pa.int32())])


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _fix_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matrices (row, chunk, matrix, height) sorted by row and chunk to the states at each chunk's two ends."""
    key, held = None, []

    def solve():
        s = boundary_states(held)
        return _rows(_STATES, [(key, k, a, b) for k, (a, b) in enumerate(zip(s, s[1:], strict=False))])

    for batch in batches:
        for r, m, height in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
            if r != key:
                if held:
                    yield solve()
                key, held = r, []
            held.append(np.frombuffer(m, np.int64).reshape(height, -1))
    if held:
        yield solve()


def _backtrack(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            out = []
            for left, part, open_out, enter, leave in zip(*(batch.column(c).to_pylist() for c in ("left", "part", "open_out", "enter", "leave")), strict=True):
                entries, exits = _borders(model, left, part, bool(left), open_out)
                (s, before), t = entries[enter], exits[leave][0] if exits else 0
                text = left[len(left) - s :] + part
                out.append(np.array(model.encode(text[: len(text) - t], before, s), "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_hash", "chunk", "n_chunks")), pa.array(out, pa.binary())], ["doc_id", "text_hash", "chunk", "n_chunks", "ids"])

    return run


def encode_pieces(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text_hash, chunk, n_chunks, ids) with little-endian unsigned 32-bit ids; a text's ids are those of its
    chunks in order, and the same for every `chunk` (which is two pieces long at least).

    Null and empty texts have no ids; every row of docs comes out, so a row that is there twice gives its chunks twice; rows
    without id are encoded too; other columns are not read; an empty table gives none."""
    t = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(t).alias("text_hash"), F.monotonically_increasing_id().alias("row"), t.alias("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) >= chunk
    out = ("doc_id", "text_hash", "chunk", "n_chunks", "ids")
    short = map_in_arrow(rows.where(~long), _chunker(path, chunk), _CHUNKS_DDL).select(*out)
    cut = saved(map_in_arrow(rows.where(long), _chunker(path, chunk), _CHUNKS_DDL), "chunks")  # rows keep their number from here on
    many = cut.where("n_chunks > 1")
    ordered = many.select("row", "chunk", "matrix", "height").repartition("row").sortWithinPartitions("row", "chunk")
    states = map_in_arrow(ordered, _fix_states, "row bigint, chunk int, enter int, leave int")
    parts = many.select("row", "doc_id", "text_hash", "chunk", "n_chunks", "left", "part", "open_out").join(states.hint("merge"), ["row", "chunk"])
    traced = map_in_arrow(parts.select("doc_id", "text_hash", "chunk", "n_chunks", "left", "part", "open_out", "enter", "leave"), _backtrack(path), "doc_id bigint, text_hash bigint, chunk int, n_chunks int, ids binary")
    return short.unionByName(cut.where("n_chunks = 1").select(*out)).unionByName(traced)


def _decoder(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                out = []
                for k, ids in zip(b.column("chunk").to_pylist(), b.column("ids").to_pylist(), strict=True):
                    raw = b"".join([model.raw[i] for i in np.frombuffer(ids, "<u4").tolist()])
                    out.append(raw[1:] if k == 0 and model.prefix and raw[:1] == b" " else raw)
                cols = [b.column(c) for c in ("doc_id", "text_hash", "chunk")]
                n = pa.array([len(x) // 4 for x in b.column("ids").to_pylist()], pa.int64())
                crc = pa.array([zlib.crc32(x) for x in b.column("ids").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*cols, n, crc, pa.array(out, pa.binary())], ["doc_id", "text_hash", "chunk", "n_pieces", "ids_crc32", "bytes"])

    return run


def decode_pieces(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (doc_id, text_hash, chunk, n_pieces, ids_crc32, bytes); a text's bytes are those of its chunks in order. A chunk may end within
    a code point, so bytes and not text come back for it."""
    return map_in_arrow(encoded.select("doc_id", "text_hash", "chunk", "ids"), _decoder(path), "doc_id bigint, text_hash bigint, chunk int, n_pieces bigint, ids_crc32 bigint, bytes binary")


def op10(spark, sf_dir: str) -> DataFrame:
    """One row for each chunk of each text: its pieces, and a digest of what decoding them gives back."""
    out = decode_pieces(encode_pieces(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))))
    return out.select("doc_id", "chunk", "n_pieces", "ids_crc32", F.length("bytes").cast("long").alias("n_bytes"), F.crc32("bytes").alias("text_crc32"))
