"""Best-fit packing of token sequences with a bounded number of open bins."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PIECES, Remembered, Vocabulary, chunks_of, vocabulary_path
from .common import scratch, stored

PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id bigint, offset bigint"
#: Bins open at a time in one packing task.
OPEN_BINS = 1024
#: Pieces that a task looks ahead: of so many at a time the longest goes first. 1 is best-fit in the order of arrival.
AHEAD = 1000
#: What one packing task takes, about. Only its open bins at the end, OPEN_BINS at most, may stay short of full: of
#: the 65,536 sequences of so many tokens that is 1.6 % at the very worst.
TOKENS_PER_TASK, PIECES_PER_TASK = 1 << 27, 1 << 21


class IdBytes:
    """Token ids of a text as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        words = Vocabulary(path)
        self.special, self.splits = words.special, words.splits
        self.model = tiktoken.Encoding("from-file", pat_str=PIECES, mergeable_ranks=words.ids, special_tokens={})
        self.known = Remembered(self._bytes)

    def _bytes(self, chunk: str) -> bytes:
        ids = [self.special[chunk]] if chunk in self.special else self.model.encode_ordinary(chunk)
        return np.array(ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        out = []
        for chunks in chunks_of(text, self.splits, self.special):
            out += map(self.known.__getitem__, chunks) if len(chunks) > 1 else map(self._bytes, chunks)
        return b"".join(out)


_made: dict[str, IdBytes] = {}


def pieces(docs: DataFrame, most: int = 2048, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Each document's ids and end_id, cut where longer than most.

    Cut pieces hold most tokens but for the first, which takes the rest, so
    that all later ones fill a sequence. Null text is an empty document: its
    one piece is end_id alone. Repeated rows are packed once each. `turn`
    numbers the pieces of a task, so that even equal rows can be dealt apart.
    """
    path = path or vocabulary_path()

    def run(parts):
        if path not in _made:
            _made[path] = IdBytes(path)
        ids_of, end, made = _made[path], np.array([end_id], "<u4").tobytes(), 0
        for part in parts:
            rows = []
            for row, text in enumerate(part.column("text").to_pandas()):
                ids = ids_of(text or "") + end
                n = len(ids) // 4
                size, start, k = (n % most or most), 0, 0
                while start < n:
                    rows.append((row, k, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)])))
                    start, size, k = start + size, most, k + 1
            row, k, start, size, crc = np.array(rows, np.int64).reshape(-1, 5).T
            arrays = [part.column("doc_id").take(pa.array(row)), pa.array(k.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc), pa.array(np.arange(made, made + len(row)))]
            made += len(row)
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "turn"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECE_SCHEMA + ", turn bigint")


class OpenBins:
    """Open bins by free space. Bit f of ``free`` is set while some bin has f tokens left."""

    def __init__(self, size: int, most_open: int):
        self.size, self.most_open = size, most_open
        self.free, self.open, self.made = 0, 0, 0
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, space: int) -> int:
        bins = self.at[space]
        out = bins.pop()
        if not bins:
            self.free &= ~(1 << space)
        self.open -= 1
        return out

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it: the tightest open bin that fits, else a new one."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(space)
        else:
            if self.open >= self.most_open:  # the fullest closes
                self._take((self.free & -self.free).bit_length() - 1)
            bin_, space = self.made, self.size
            self.made += 1
        left = space - length
        if left:
            self.at[left].append(bin_)
            self.free |= 1 << left
            self.open += 1
        return bin_, self.size - space


def pack(cut: DataFrame, most: int = 2048, most_open: int = OPEN_BINS, tasks: int = 1, ahead: int = AHEAD) -> DataFrame:
    """Places the pieces; sequence ids are unique over all tasks.

    A task packs its own share by itself. Pieces are dealt by everything that
    tells them apart, so neither a hot document nor rows without an id nor
    the whole input meet in one task. They come in a hashed order, `ahead` at
    a time with the longest first, whatever the size of the Arrow batches.
    Ties between bins of equal space go to the newest.
    """

    def run(parts):
        from pyspark import TaskContext

        bins, base = OpenBins(most, most_open), TaskContext.get().partitionId() << 40

        def placed(part: pa.Table) -> pa.RecordBatch:
            length = part.column("length").to_numpy()
            at = np.empty((len(length), 2), np.int64)
            for row in np.argsort(-length, kind="stable"):
                at[row] = bins.place(int(length[row]))
            part = part.append_column("sequence_id", pa.array(base + at[:, 0])).append_column("offset", pa.array(at[:, 1]))
            return part.combine_chunks().to_batches()[0]

        held, rows = [], 0
        for part in parts:
            held.append(part)
            rows += part.num_rows
            if rows >= ahead:
                whole = pa.Table.from_batches(held)
                full = rows - rows % ahead
                for start in range(0, full, ahead):
                    yield placed(whole.slice(start, ahead))
                held, rows = whole.slice(full).to_batches(), rows % ahead
        if rows:
            yield placed(pa.Table.from_batches(held))

    order = [F.xxhash64("turn", "doc_id", "piece", "length", "ids_crc32"), "doc_id", "piece", "start", "length", "ids_crc32", "turn"]
    # a set order within the task: a rerun after a lost executor gives the same sequences
    dealt = cut.repartition(max(tasks, 1), F.xxhash64("doc_id", "piece", "length", "ids_crc32", "turn")).sortWithinPartitions(*order)
    return dealt.drop("turn").mapInArrow(run, PACKED_SCHEMA)


def pack_documents(docs: DataFrame, most: int = 2048, path: str | None = None, ahead: int = AHEAD, tokens_per_task: int = 0, pieces_per_task: int = 0) -> DataFrame:
    """Every document of docs in sequences of at most `most` tokens, one row for each piece. Other columns are dropped.

    The number of packing tasks follows from the pieces and their tokens (0: TOKENS_PER_TASK and PIECES_PER_TASK).
    """
    # stored, so that counting them doesn't tokenize twice: a long text is many pieces
    cut = stored(pieces(docs, most, path=path), f"{scratch(docs.sparkSession)}/pieces")
    held = cut.agg(F.count(F.lit(1)).alias("pieces"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
    return pack(cut, most, tasks=max(-(-held["tokens"] // (tokens_per_task or TOKENS_PER_TASK)), -(-held["pieces"] // (pieces_per_task or PIECES_PER_TASK))), ahead=ahead)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return pack_documents(docs)
