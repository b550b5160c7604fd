"""Packing of token ids into sequences of a fixed length, balanced by estimated attention cost.

Documents become ids in Arrow batches. Whole chunks of `length` ids fill a sequence each; what is left of a document is
buffered. A full buffer is packed: its tokens set how many sequences there are (full ones and, for the rest, powers of two,
which need no padding), then descending remainders go each to the sequence of lowest cost (linear plus quadratic in the
piece's length) that still has room; where none has, the piece is cut. Nothing is shuffled, and a task's memory is bounded by
the buffer whatever the table's size."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionforge.llm.common import table
from mentionforge.session import map_in_arrow

LENGTH, BUFFER, END_ID = 1024, 2048, 0
#: Weights of a piece of n ids in a sequence of `length`: LINEAR * n + QUADRATIC * n * n / length.
LINEAR, QUADRATIC = 1.0, 1.0
_ENCODINGS: dict[tuple, tiktoken.Encoding] = {}


def added_tokens() -> dict[str, int]:
    """The added tokens of byte_bpe_50k.json, which the library finds in plain text too."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}


def encoding(ranks_path: str | None = None, pattern: str | None = None, added: dict[str, int] | None = None) -> tiktoken.Encoding:
    """The byte-level BPE as ranks: the ids of byte_bpe_50k.json, some four times as fast. Strings of `added` are one id each,
    other special strings are text."""
    import public_tokenizers

    key = (ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN, *sorted((added or {}).items()))
    if key not in _ENCODINGS:
        with open(key[0], "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[key] = tiktoken.Encoding("byte_bpe", pat_str=key[1], mergeable_ranks=ranks, special_tokens=added or {})
    return _ENCODINGS[key]


def sequence_sizes(tokens: int, length: int = LENGTH) -> np.ndarray:
    """Sizes that add up to tokens: full sequences, then falling powers of two."""
    rest = tokens % length
    bits = [1 << b for b in range(length.bit_length(), -1, -1) if rest >> b & 1]
    return np.array([length] * (tokens // length) + bits, dtype=np.int64)


def assign(sizes_of_items: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start in item, length, sequence, offset) that fill sequence_sizes(sum) exactly."""
    room = sequence_sizes(sum(sizes_of_items), length)
    capacity, cost, out = room.copy(), np.zeros(len(room)), []
    for item in sorted(range(len(sizes_of_items)), key=lambda i: (-sizes_of_items[i], i)):
        start, left = 0, sizes_of_items[item]
        while left:
            fits = room >= left
            k = int(np.where(fits, cost, np.inf).argmin()) if fits.any() else int(room.argmax())
            n = min(left, int(room[k]))
            out.append((item, start, n, k, int(capacity[k] - room[k])))
            room[k] -= n
            cost[k] += LINEAR * n + QUADRATIC * n * n / length
            start, left = start + n, left - n
    return out


def _packer(length: int, buffer: int, ranks_path: str | None, special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added = added_tokens() if special else {}
        whole_bpe, allowed = encoding(ranks_path, added=added), set(added)
        ordinary = whole_bpe.encode_ordinary

        def encode(text: str) -> list[int]:
            return whole_bpe.encode(text, allowed_special=allowed, disallowed_special=()) if any(a in text for a in allowed) else ordinary(text)

        base, used = TaskContext.get().partitionId() << 36, 0
        tails, cols = [], [[] for _ in range(7)]

        def put(*row):
            for c, v in zip(cols, row, strict=True):
                c.append(v)

        def flush():
            nonlocal used, tails
            for item, start, n, k, offset in assign([len(t[2]) for t in tails], length):
                doc, before, ids, total = tails[item]
                put(doc, before + start, n, ids[start : start + n].tobytes(), total, base + used + k, offset)
            used += len(sequence_sizes(sum(len(t[2]) for t in tails), length))
            tails = []

        def batch_out():
            nonlocal cols
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            cols = [[] for _ in range(7)]
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END_ID], dtype="<u4")
                doc, whole = doc.as_py(), len(ids) // length * length
                for at in range(0, whole, length):
                    put(doc, at, length, ids[at : at + length].tobytes(), len(ids), base + used, 0)
                    used += 1
                if whole < len(ids):
                    tails.append((doc, whole, ids[whole:], len(ids)))
                if len(tails) >= buffer:
                    flush()
                if len(cols[0]) >= 4096:
                    yield batch_out()
        flush()
        yield batch_out()

    return run


def pack(docs: DataFrame, length: int = LENGTH, buffer: int = BUFFER, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", special: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset); ids are little-endian unsigned 32-bit.

    With `special`, an added token of the tokenizer's file that stands in a text is its one id, as in the library's default
    setting; else it is ordinary text. A null text counts as empty and is the end id alone; rows without id are packed with a null doc_id; repeated rows are
    packed each; other columns are not read. Sequence ids are unique across tasks and the same when a task runs again."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return map_in_arrow(rows, _packer(length, buffer, ranks_path, special), "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4(spark, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents"), special=True))
