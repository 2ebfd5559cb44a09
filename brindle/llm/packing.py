"""Bounded-space online packing of token ids into fixed windows.

Each task keeps at most OPEN windows open. A document's ids (with the end id)
are cut into full windows; its remainder goes best-fit into the open window
with the smallest gap that holds it. If none does and no more may be opened,
the fullest is topped up with the head of the remainder and emitted, so emitted
windows are full. At the end of a task its open windows are merged into full
ones, and what is left of a task (under one window) is merged with that of the
next tasks, GROUP tasks at a time. The last ids of a group are cut into windows
whose lengths are powers of two, which need no padding.

Pieces are written to the shared folder before leftovers are merged, so both
come from one and the same attempt of every task.

Ids are those of the tokenizers library without added special tokens; the same
vocabulary is read by tiktoken, which gives the same ids several times faster,
where a text holds no special token's string and no run of white space of
LONG_RUN or more characters, on whose length tiktoken's pattern search recurses.

Defined cases: a null text counts as empty and gives the end id alone; a null
id is kept; repeated rows are documents of their own; an empty table gives no
rows; a document of any length is cut as needed. Other columns of the input
play no part, whatever their names.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import common as C

WINDOW = 1024
OPEN = 32
GROUP = 32
END_ID = 0
LONG_RUN = 10_000
_FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, task int, ids binary"
_MERGED = 1 << 62
_RUN = re.compile(r"\s{%d}" % LONG_RUN)


def vocabulary() -> str:
    """Where the public byte-level vocabulary lies, by default."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from text to ids, as the tokenizers library gives them."""
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    try:
        import public_tokenizers

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    except (FileNotFoundError, ImportError):  # a vocabulary without a rank file
        fast = None

    def encode(text: str) -> list[int]:
        if fast is None or any(s in text for s in special) or len(text) >= LONG_RUN and _RUN.search(text):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


class Packer:
    """The open windows of one task."""

    def __init__(self, task: int, keep_ids: bool) -> None:
        self.task, self.keep_ids = task, keep_ids
        self.windows: list[list] = []  # [used, pieces]; a piece is (doc_id, start, ids, doc_tokens)
        self.emitted = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n = len(ids)
        full = n - n % WINDOW
        for at in range(0, full, WINDOW):
            self.emit([(doc_id, at, ids[at : at + WINDOW], n)])
        at = full
        while at < n:
            left = n - at
            fits = [w for w in self.windows if w[0] + left <= WINDOW]
            if fits:
                window = max(fits, key=lambda w: w[0])
            elif len(self.windows) < OPEN:
                window = [0, []]
                self.windows.append(window)
            else:
                window = max(self.windows, key=lambda w: w[0])
                left = WINDOW - window[0]
            window[1].append((doc_id, at, ids[at : at + left], n))
            window[0] += left
            at += left
            if window[0] == WINDOW:
                self.windows.remove(window)
                self.emit(window[1])

    def emit(self, pieces: list, leftover: bool = False) -> None:
        sequence, offset = (self.task << 32) + self.emitted, 0
        for doc_id, start, ids, n in pieces:
            raw = ids.tobytes()
            self.rows.append((doc_id, start, len(ids), zlib.crc32(raw), n, None if leftover else sequence, offset, self.task, raw if leftover or self.keep_ids else None))
            offset += len(ids)
        self.emitted += not leftover

    def close(self) -> None:
        """Merge the open windows into full ones; what remains is left over."""
        pieces = [p for w in sorted(self.windows, key=lambda w: -w[0]) for p in w[1]]
        self.windows = []
        windows = list(filled(pieces))
        for window in windows:
            self.emit(window, leftover=sum(len(p[2]) for p in window) < WINDOW)

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[]] * 9
        self.rows = []
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.binary()]
        names = [*_FIELDS, "task", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def filled(pieces: list) -> Iterator[list]:
    """Pieces in order, cut into full windows; the last may be short."""
    window, used = [], 0
    for doc_id, start, ids, n in pieces:
        at = 0
        while at < len(ids):
            part = ids[at : at + WINDOW - used]
            window.append((doc_id, start + at, part, n))
            used += len(part)
            at += len(part)
            if used == WINDOW:
                yield window
                window, used = [], 0
    if window:
        yield window


def unpadded(window: list) -> Iterator[list]:
    """A short window cut into windows whose lengths are powers of two, longest first."""
    pieces = list(window)
    left = sum(len(p[2]) for p in pieces)
    while left:
        want, out = 1 << (left.bit_length() - 1), []
        left -= want
        while want:
            doc_id, start, ids, n = pieces.pop(0)
            out.append((doc_id, start, ids[:want], n))
            if len(ids) > want:
                pieces.insert(0, (doc_id, start + want, ids[want:], n))
            want -= len(out[-1][2])
        yield out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece: which ids of which document lie where in which sequence; with_ids adds them."""
    C.ready(docs.sparkSession)
    path = path or vocabulary()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        packer = Packer(pyspark.TaskContext.get().partitionId(), with_ids)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                packer.add(doc_id, np.array([*encode(text.as_py() or ""), END_ID], dtype="<u4"))
            yield packer.take()
        packer.close()
        yield packer.take()

    def merged(rows: pa.Table) -> pa.Table:
        got = rows.sort_by([("task", "ascending"), ("offset", "ascending")]).to_pylist()
        pieces = [(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]) for r in got]
        packer = Packer(0, True)
        for window in filled(pieces):
            full = sum(len(p[2]) for p in window) == WINDOW
            for part in [window] if full else unpadded(window):
                packer.emit(part)
        out = packer.take()
        sequence = pc.add(out.column("sequence_id"), _MERGED + (got[0]["task"] // GROUP << 20))
        return pa.Table.from_batches([out.set_column(5, "sequence_id", sequence)])

    rows = C.on_all_cores(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(packed, _SCHEMA)
    rows = C.staged(rows, "pieces")
    last = rows.where("sequence_id is null").withColumn("g", F.expr(f"task div {GROUP}")).groupBy("g").applyInArrow(merged, _SCHEMA)
    every = rows.where("sequence_id is not null").unionByName(last)
    return every.select(*_FIELDS, *(["ids"] if with_ids else []))
