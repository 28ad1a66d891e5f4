"""Cost-balanced packing of tokenized documents into fixed-length sequences.

Every partition of the scan packs its own documents in windows of a bounded number of pieces: nothing is shuffled,
a lost task is run again over the same rows. Inside a window the pieces go, longest first, to the sequence of
lowest cost that still has room for them; the cost of a piece is linear in its length (projections) plus quadratic
(attention inside the piece). A piece that fits nowhere is cut at the largest room left.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, slices

LENGTH = 1024
#: Pieces that are packed together; bounds a task's memory to this many pieces of LENGTH ids.
WINDOW = 8192
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / LENGTH
END = 0
#: Chunks whose ids a worker remembers; the memo starts anew beyond it.
MEMO = 600_000

OUT = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_length bigint"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


class ByteBpe:
    """Ids of a byte-level BPE vocabulary file (tokenizers' JSON), as little-endian unsigned 32-bit bytes.

    Byte-level BPE splits a text before it merges, and a single space before a non-space always begins a split; so
    a text's ids are those of its chunks between such spaces, and chunks are remembered. Texts with other uses of
    spaces are encoded whole.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    ODD = re.compile(r" (?:\s|\Z)")

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # the printable stand-ins of byte-level BPE: bytes that print stand for themselves, the others follow from 256 on
        prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stand = {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in prints)}
        ranks = {bytes(stand[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.added = added
        self.core = tiktoken.Encoding("packing", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.memo: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.core.encode(text, allowed_special="all", disallowed_special=()), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.ODD.search(text):
            return self._whole(text)
        memo, first, *rest = self.memo, *text.split(" ")
        if len(memo) > MEMO:
            memo.clear()
        try:
            return self._whole(first) + b"".join([memo[x] for x in rest])
        except KeyError:
            for x in rest:
                if x not in memo:
                    memo[x] = self._whole(f" {x}")
            return self._whole(first) + b"".join([memo[x] for x in rest])


_loaded: dict[str, ByteBpe] = {}


def bpe(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def rooms(total: int, length: int) -> list[int]:
    """Lengths of the sequences for so many tokens: full ones, and powers of two for the rest, so that none is padded."""
    rest = total % length
    return [length] * (total // length) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def assign(lengths: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pack pieces of these lengths (each under `length`). Returns (piece, start in it, tokens, sequence, offset)."""
    room = rooms(sum(lengths), length)
    size = list(room)
    best = np.full(length + 1, np.inf)  # lowest cost of the sequences with so much room
    heaps: dict[int, list] = {}

    def put(cost: float, seq: int) -> None:
        h = heaps.setdefault(room[seq], [])
        heapq.heappush(h, (cost, seq))
        best[room[seq]] = h[0][0]

    def take(r: int) -> tuple[float, int]:
        out = heapq.heappop(heaps[r])
        best[r] = heaps[r][0][0] if heaps[r] else np.inf
        return out

    for s in range(len(room)):
        put(0.0, s)
    out = []
    for n, piece in sorted(((n, i) for i, n in enumerate(lengths)), key=lambda x: (-x[0], x[1])):
        start = 0
        while start < n:
            left = n - start
            r = left + int(best[left:].argmin())
            if best[r] == np.inf:  # no room for all of it
                r = int(np.nonzero(best[:left] < np.inf)[0][-1])
            cost, seq = take(r)
            k = min(left, r)
            out.append((piece, start, k, seq, size[seq] - room[seq]))
            room[seq] -= k
            start += k
            if room[seq]:
                put(cost + LINEAR * k + QUADRATIC * k * k, seq)
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """A row for each piece of a document: its id, and start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_length.

    A document is its text's ids and then id 0; null and empty texts are that id alone. A document over `length` is
    cut into full sequences first. Sequences are full, but for the last of a window, which are powers of two; so
    there is no padding. Repeated rows and null ids are documents like others. No rows: no rows. All other columns go.
    """
    path = path or tokenizer_path()
    rows = docs.select(F.col(id_col).alias("pk_id"), F.col(text_col).cast("string").alias("pk_text"), F.spark_partition_id().alias("pk_part"))
    kind = rows.schema["pk_id"].dataType.simpleString()
    end = np.array([END], "<u4").tobytes()

    def run(batches):
        encode = bpe(path).encode
        sequence, pieces, names, id_type = None, [], None, None  # pieces: id, start in the document, ids (of a full one their checksum), its tokens

        def flush(pieces, sequence):
            columns: list[list] = [[] for _ in range(8)]
            short = []
            for p in pieces:
                if isinstance(p[2], int):
                    for c, v in zip(columns, (p[0], p[1], length, p[2], p[3], sequence, 0, length), strict=True):
                        c.append(v)
                    sequence += 1
                else:
                    short.append(p)
            sizes = rooms(sum(len(p[2]) for p in short) // 4, length)
            for i, start, n, seq, offset in assign([len(p[2]) // 4 for p in short], length):
                doc, at, ids, tokens = short[i]
                for c, v in zip(columns, (doc, at + start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), tokens, sequence + seq, offset, sizes[seq]), strict=True):
                    c.append(v)
            return columns, sequence + len(sizes)

        def batch_of(columns):
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *[pa.array(c, pa.int64()) for c in columns[1:]]], names)

        for batch in slices(batches):
            if sequence is None and batch.num_rows:
                sequence = batch.column(2)[0].as_py() << 40  # unique over the partitions
                id_type, names = batch.schema.field(0).type, [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                tokens = len(ids) // 4
                for at in range(0, tokens, length):
                    piece = ids[4 * at : 4 * (at + length)]
                    pieces.append((doc, at, zlib.crc32(piece) if len(piece) == 4 * length else piece, tokens))
                    if len(pieces) == window:
                        columns, sequence = flush(pieces, sequence)
                        pieces = []
                        yield batch_of(columns)
        if pieces:
            columns, sequence = flush(pieces, sequence)
            yield batch_of(columns)

    return rows.mapInArrow(run, f"`{id_col}` {kind}, {OUT}")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
