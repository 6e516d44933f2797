"""Bounded-space online packing of documents into token windows."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineside.llm.tables import texts
from lineside.llm.tokens import _SPECIAL, piece_ids, pre_tokens, split_words, tokenizer
from lineside.session import settle

#: Partitions whose leftover windows are merged in one task: 64 x 16 windows of at most 8 KB.
MERGED_PARTITIONS = 64
COLUMNS = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


class Packer:
    """Keeps at most ``windows`` open windows of ``size`` tokens.

    A piece goes to the open window that it fills best. If it fits in none and no further window
    may be opened, the fullest one is emitted: as it is when at most ``slack`` tokens are free,
    else the piece's head fills it up first and the rest is placed again.
    """

    def __init__(self, size: int, windows: int, slack: int, first_id: int):
        self.size, self.windows, self.slack, self.next_id = size, windows, slack, first_id
        self.open: list[list] = []  # [used, pieces]
        self.out: list[tuple] = []

    def add(self, doc: int | None, start: int, total: int, ids: bytes) -> None:
        while ids:
            n = len(ids) // 4
            if n >= self.size:
                self._emit([(doc, start, total, ids[:4 * self.size])])
                ids, start = ids[4 * self.size:], start + self.size
                continue
            fitting = [w for w in self.open if w[0] + n <= self.size]
            if fitting:
                self._place(max(fitting, key=lambda w: w[0]), doc, start, total, ids)
                return
            if len(self.open) < self.windows:
                self.open.append([0, []])
                self._place(self.open[-1], doc, start, total, ids)
                return
            full = max(self.open, key=lambda w: w[0])
            free = self.size - full[0]
            if free <= self.slack:
                self.open.remove(full)
                self._emit(full[1])
            else:
                self._place(full, doc, start, total, ids[:4 * free])
                ids, start = ids[4 * free:], start + free

    def _place(self, window: list, doc, start: int, total: int, ids: bytes) -> None:
        window[0] += len(ids) // 4
        window[1].append((doc, start, total, ids))
        if window[0] == self.size:
            self.open.remove(window)
            self._emit(window[1])

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, total, ids in pieces:
            self.out.append((doc, start, len(ids) // 4, total, self.next_id, offset, ids))
            offset += len(ids) // 4
        self.next_id += 1

    def left(self) -> list[tuple]:
        """The pieces of the windows that are still open, fullest window first."""
        return [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]

    def close(self) -> None:
        """Fill windows with what is left, one after the other; only the last may stay short."""
        pieces, self.open, self.windows = self.left(), [], 1
        used: list[tuple] = []
        free = self.size
        for doc, start, total, ids in pieces:
            while ids:
                head, ids = ids[:4 * free], ids[4 * free:]
                used.append((doc, start, total, head))
                start, free = start + len(head) // 4, free - len(head) // 4
                if not free:
                    self._emit(used)
                    used, free = [], self.size
        if used:
            self._emit(used)


class _Ids(dict):
    """Word -> its token ids as bytes, looked up by word and by pre-token; both of bounded size."""

    def __init__(self, name: str, most: int = 250_000):
        self.name, self.most, self.pieces = name, most, {}

    def load(self, words: list[str]) -> None:
        """Encode what is new among ``words``, all its unseen pre-tokens in one call."""
        fresh = {w: pre_tokens(w, self.name) for w in words if w not in self}
        if not fresh:
            return
        unseen = list({p for pieces in fresh.values() for p in pieces if p not in self.pieces})
        for at in range(0, len(unseen), 2000):
            block = unseen[at:at + 2000]
            self.pieces.update((p, array("I", ids).tobytes()) for p, ids in zip(block, piece_ids(block, self.name)))
        for word, pieces in fresh.items():
            self[word] = b"".join(map(self.pieces.__getitem__, pieces))

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()
        if len(self.pieces) > self.most:
            self.pieces.clear()


_known: dict[str, _Ids] = {}


def encoded(rows: list[str], name: str) -> Iterator[bytes]:
    """Little-endian unsigned 32-bit ids of each text."""
    known = _known.setdefault(name, _Ids(name))
    parts = [_SPECIAL.split(t) if "<|" in t else [t] for t in rows]
    words = [[split_words(p) for p in part] for part in parts]
    known.load(list({w for row in words for part in row for w in part}))
    for text, row in zip(rows, words):
        if len(row) == 1:
            yield b"".join(map(known.__getitem__, row[0]))
            continue
        marks = [array("I", [tokenizer(name).token_to_id(m)]).tobytes() for m in _SPECIAL.findall(text)] + [b""]
        yield b"".join(b"".join(map(known.__getitem__, part)) + mark for part, mark in zip(row, marks))
    known.trim()


def pack(docs: DataFrame, name: str = "word_bpe_49k.json", size: int = 2048, end_id: int = 1,
         windows: int = 16, slack: int = 16, keep_ids: bool = False) -> DataFrame:
    """Cut all documents into pieces and lay these into sequences of at most ``size`` tokens.

    Returns a row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``
    and, with ``keep_ids``, ``ids`` (little-endian unsigned 32-bit). Each partition packs its
    documents as they come with at most ``windows`` open windows, and writes its open windows down
    at the end; the leftovers of up to 64 partitions are merged in one task. So memory is bounded
    by windows and one batch, whatever the input. ``sequence_id`` is made of the partition (or the
    merge group, above 2^62) and a running number.

    A null text counts as empty; an empty text is the end id alone. Repeated rows are packed each;
    an empty table gives no rows; other columns are not read.
    """
    kind = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    schema = pa.schema([(c, pa.binary() if c == "ids" else pa.int64()) for c in COLUMNS])
    end = array("I", [end_id]).tobytes()

    def rows_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(COLUMNS, map(list, zip(*found)))) if found else {c: [] for c in COLUMNS}, schema=schema)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer = Packer(size, windows, slack, part << 32)
        for batch in batches:
            found = [t or "" for t in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoded(found, name)):
                packer.add(doc, 0, len(ids) // 4 + 1, ids + end)
            yield rows_of(packer.out)
            packer.out = []
        # Leftovers carry the partition in place of a sequence, and no offset.
        yield rows_of([(d, s, len(i) // 4, t, part, None, i) for d, s, t, i in packer.left()])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in COLUMNS))]
        if not pieces:
            return
        packer = Packer(size, windows, slack, 1 << 62 | pieces[0][4] // MERGED_PARTITIONS << 32)
        for doc, start, _, total, _, _, ids in sorted(pieces, key=lambda p: (p[4], p[0] is None, p[0] or 0, p[1])):
            packer.add(doc, start, total, ids)
        packer.close()
        yield rows_of(packer.out)

    kept = F.col("ids") if keep_ids else F.when(F.col("offset").isNull(), F.col("ids"))
    packed = settle(texts(docs).mapInArrow(first, kind).select(
        *COLUMNS[:-1], F.crc32("ids").alias("ids_crc32"), kept.alias("ids")))
    left = (packed.where("offset IS NULL").select(*COLUMNS)
            .groupBy(F.expr(f"sequence_id div {MERGED_PARTITIONS}"))
            .applyInArrow(_grouped(merge), kind)
            .select(*COLUMNS[:-1], F.crc32("ids").alias("ids_crc32"), "ids"))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return packed.where("offset IS NOT NULL").unionByName(left).select(*out, *["ids"] * keep_ids)


def _grouped(work):
    """A function of a whole group's table (bounded by the caller) from one over batches."""

    def run(group: pa.Table) -> pa.Table:
        found = list(work(iter(group.to_batches())))
        return pa.Table.from_batches(found) if found else group.slice(0, 0)

    return run
