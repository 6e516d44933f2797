"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, both id lists are cut into groups."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineside.llm.tables import texts, written
from lineside.llm.tokens import tokenizer_path

#: Texts are worked through in stretches of about so many characters.
STRETCH = 1 << 20
#: Units and their characters kept in a task's memory, and the longest unit that is encoded with others.
KNOWN, KNOWN_CHARS, LONG = 400_000, 1 << 24, 256
#: Units that are encoded in one call.
BLOCK = 1024
#: Ids of a group from which on equal ones are counted before they are linked.
CROWD = 8

# White space of either tokenizer or of Python, but for space and line feed, and invisible marks that some tables call space.
_ODD = r"\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
_ODD_SPACE = re.compile(f"[{_ODD}]")
_CUT = re.compile(rf"(?<=[^ \n{_ODD}])(?=[ \n][^ \n{_ODD}])")
_ANY_SPACE = re.compile(rf"[ \n{_ODD}]")
_loaded: dict[tuple[str, str], Pair] = {}


class Pair:
    """Both tokenizers with the bytes and the decimal form of every id; read once in each Python worker."""

    def __init__(self, name_a: str, name_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has its one core
        self.a = Tokenizer.from_file(tokenizer_path(name_a))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name_b))
        letters = _byte_letters()
        # An added token has no byte-level form; it never comes out of plain text.
        self.bytes_a = [bytes(map(letters.__getitem__, t)) if all(c in letters for c in t) else t.encode()
                        for t in map(self.a.id_to_token, range(self.a.get_vocab_size()))]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode()
                        for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.long_a, self.long_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        #: Every id in decimal with what may come after it: two forms of each A id, then three of each B id.
        self.decimal = [b"%d%b" % (i, after) for t, more in ((self.bytes_a, (b",", b"|")), (self.bytes_b, (b",", b";", b"\n")))
                        for i in range(len(t)) for after in more]
        # A unit may be encoded by itself only if no piece reaches over its border.
        inside = [p for i, p in enumerate(self.bytes_b) if not (self.b.is_byte(i) or self.b.is_control(i)) and (b"\n" in p or b" " in p.lstrip(b" "))]
        if inside:
            raise ValueError(f"pieces with white space inside: {inside[:3]}")

    def ids(self, block: str) -> tuple[list[int], list[int]]:
        """The ids of a text that already begins with its space (or of a later stretch of one)."""
        two = self.b.encode(block[1:]) if block[0] == " " else self.b.encode(block)[1:]
        return self.a.encode_batch_fast([block], add_special_tokens=False)[0].ids, two


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def pair_of(name_a: str, name_b: str) -> Pair:
    if (name_a, name_b) not in _loaded:
        _loaded[name_a, name_b] = Pair(name_a, name_b)
    return _loaded[name_a, name_b]


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The groups in order: the byte where both tokenizers end, and how many ids of each lie before it."""
    at_a, at_b = (dict(zip(ends.tolist(), range(1, len(ends) + 1))) for ends in (ends_a, ends_b))
    common = [end for end in at_a if end in at_b]
    return np.array(common, np.int64), *(np.fromiter(map(at.__getitem__, common), np.int64, len(common)) for at in (at_a, at_b))


def stretches(text: str) -> Iterator[str]:
    """``text`` in pieces that both tokenizers treat alike alone and together."""
    at = 0
    while len(text) - at > STRETCH and (cut := _CUT.search(text, at + STRETCH)):
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def units(stretch: str) -> list:
    """The stretch cut before each lone space or line feed between visible characters.

    No pre-token of one tokenizer and no piece of the other reaches over such a cut, so units are
    encoded once each. A plain unit is its word without the space before it, or begins with its line feed;
    any other is a tuple with the stretch itself.
    """
    if (stretch[-1] not in " \n" and "  " not in stretch and "\n\n" not in stretch and " \n" not in stretch
            and "\n " not in stretch and not _ODD_SPACE.search(stretch)):
        return stretch.replace("\n", " \n").split(" ")[1:]
    return [(u[1:] if u[0] == " " else u) if len(u) > 1 and not _ANY_SPACE.search(u, 1) else (u,) for u in _CUT.split(stretch)]


def whole(unit: str | tuple[str]) -> str:
    """The characters of a unit."""
    return unit[0] if type(unit) is tuple else unit if unit[0] == "\n" else " " + unit


class Numbers(dict):
    """Unit -> its number; one that is asked for first takes the next."""

    def __missing__(self, unit: str | tuple[str]) -> int:
        self[unit] = number = len(self)
        return number


class Units:
    """What is known of each unit: sizes, the written groups, and its id pairs with the links of each."""

    def __init__(self, pair: Pair, most: int = KNOWN):
        self.pair, self.most = pair, most
        self.forget()

    def forget(self) -> None:
        self.at = Numbers()
        self.chars = 0
        self.written: list[bytes] = []
        #: n_a, n_b, n_groups, n_links, broken, first pair, pairs
        self.sizes = np.zeros((0, 7), np.int64)
        self.keys, self.links = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def full(self) -> bool:
        return len(self.at) > self.most or self.chars > KNOWN_CHARS

    def numbers(self, stretch: list) -> np.ndarray:
        """The number of each unit; ``learn`` takes in the new ones."""
        return np.fromiter(map(self.at.__getitem__, stretch), np.int64, len(stretch))

    def learn(self, wanted: Iterable = ()) -> None:
        """Take in ``wanted`` and all units that have a number only."""
        for unit in wanted:
            self.at[unit]
        known = len(self.written)
        new = list(islice(reversed(self.at), len(self.at) - known))[::-1]
        other = [i for i, u in enumerate(new) if type(u) is tuple or len(u) > LONG]
        alone = set(other)
        plain = [i for i in range(len(new)) if i not in alone] if alone else range(len(new))
        self.chars += sum(len(u) if type(u) is str else len(u[0]) for u in new)
        self.written += [b""] * len(new)
        sizes = np.zeros((len(new), 7), np.int64)
        all_keys, all_links, first = [self.keys], [self.links], len(self.keys)
        waiting = [plain[at:at + BLOCK] for at in range(0, len(plain), BLOCK)] + [[i] for i in other]
        waiting.reverse()
        while waiting:
            rows = waiting.pop()
            found = self._block([new[i] for i in rows])
            if found:
                own, written, keys, links = found
                own[:, 5] += first
                sizes[rows] = own
                for i, text in zip(rows, written):
                    self.written[known + i] = text
                all_keys.append(keys)
                all_links.append(links)
                first += len(keys)
            elif len(rows) == 1:
                sizes[rows, 4] = 1  # bytes do not come back
            else:
                waiting += [[i] for i in rows]
        self.sizes = np.concatenate([self.sizes, sizes])
        self.keys, self.links = np.concatenate(all_keys), np.concatenate(all_links)

    def _block(self, block: list) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray] | None:
        """Sizes, written groups and pairs of units encoded together; None if bytes do not come back or a border is no common end."""
        raw = [whole(u).encode("utf-8", "surrogatepass") for u in block]
        together = b"".join(raw)
        ids_a, ids_b = self.pair.ids(together.decode("utf-8", "surrogatepass"))
        if b"".join(map(self.pair.bytes_a.__getitem__, ids_a)) != together or b"".join(map(self.pair.bytes_b.__getitem__, ids_b)) != together:
            return None
        ids_a, ids_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends, to_a, to_b = groups_of(np.cumsum(self.pair.long_a[ids_a]), np.cumsum(self.pair.long_b[ids_b]))
        borders = np.cumsum([len(part) for part in raw])
        last = np.searchsorted(ends, borders)
        if (ends[last] != borders).any():
            return None
        in_a, in_b, groups = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0), np.diff(last, prepend=-1)
        from_a, from_b, unit = to_a - in_a, to_b - in_b, np.repeat(np.arange(len(block)), groups)
        n_links = in_a * in_b
        keys, links = [], []
        few = np.flatnonzero(in_a + in_b <= CROWD)
        count = n_links[few]
        of = np.repeat(few, count)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        keys.append(unit[of] << 32 | ids_a[from_a[of] + nth // in_b[of]] << 16 | ids_b[from_b[of] + nth % in_b[of]])
        links.append(np.ones(len(of), np.int64))
        for g in np.flatnonzero(in_a + in_b > CROWD).tolist():
            pairs = linked(ids_a[from_a[g]:to_a[g]], ids_b[from_b[g]:to_b[g]])
            keys.append(unit[g] << 32 | pairs[0])
            links.append(pairs[1])
        keys, links = distinct(np.concatenate(keys), np.concatenate(links))
        pairs = np.bincount(keys >> 32, minlength=len(block))
        total = np.cumsum(n_links)[last]
        own = np.stack([np.diff(to_a[last], prepend=0), np.diff(to_b[last], prepend=0), groups, np.diff(total, prepend=0),
                        np.zeros(len(block), np.int64), np.cumsum(pairs) - pairs, pairs], axis=1)
        # Ids in the order in which they are written: those of A before those of B in each group.
        after_a, after_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        after_a[to_a - 1], after_b[to_b - 1] = 1, 1
        after_b[to_b[last] - 1] = 2
        forms = np.empty(len(ids_a) + len(ids_b), np.int64)
        forms[np.arange(len(ids_a)) + np.repeat(from_b, in_a)] = 2 * ids_a + after_a
        forms[np.arange(len(ids_b)) + np.repeat(to_a, in_b)] = 2 * len(self.pair.bytes_a) + 3 * ids_b + after_b
        written = b"".join(map(self.pair.decimal.__getitem__, forms.tolist())).split(b"\n")[:-1]
        return own, written, keys.astype(np.uint32), links


def linked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id pairs of a large group and the links of each: ids that come again are multiplied out."""
    (a, times), (b, more) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    return (a[:, None] << 16 | b).ravel(), (times[:, None] * more).ravel()


class Measure:
    """Adds up the units of one document."""

    def __init__(self, keep: bool):
        self.sizes, self.pairs, self.digest, self.kept, self.empty = np.zeros(5, np.int64), [], hashlib.sha256(), [] if keep else None, True

    def add(self, known: Units, stretch: list) -> None:
        self.add_numbers(known, known.numbers(stretch))

    def add_numbers(self, known: Units, at: np.ndarray) -> None:
        rows = known.sizes[at]
        self.sizes += rows[:, :5].sum(axis=0)
        if self.sizes[4]:
            self.pairs, self.kept = [], None if self.kept is None else []
            return
        count = rows[:, 6]
        where = np.repeat(rows[:, 5] - np.cumsum(count) + count, count) + np.arange(count.sum())
        self.pairs.append(distinct(known.keys[where], known.links[where]))
        if len(self.pairs) > 16:
            self.pairs = [self._merged()]
        text = b";".join(map(known.written.__getitem__, at.tolist()))
        self.digest.update(text if self.empty else b";" + text)
        self.empty = False
        if self.kept is not None:
            self.kept.append(text)

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.pairs:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return self.pairs[0] if len(self.pairs) == 1 else distinct(*(np.concatenate(x) for x in zip(*self.pairs)))

    def row(self) -> tuple:
        if self.empty or self.sizes[4]:
            return 0, 0, 0, 0, "", b"", b"", ""
        keys, links = self._merged()
        return (*self.sizes[:4].tolist(), self.digest.hexdigest(), keys.astype("<u4").tobytes(), links.astype("<i8").tobytes(),
                b";".join(self.kept).decode() if self.kept is not None else "")


def distinct(keys: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, ascending, with the sum of its links."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(links[order], first) if len(first) else np.zeros(0, np.int64)


def groups_by_document(docs: DataFrame, name_a: str, name_b: str, keep_groups: bool) -> DataFrame:
    """Per row: ``rid`` (a number for the row), ``doc_id``, sizes, the digest of the groups, its id pairs and the links of each.

    With ``keep_groups`` also ``groups``, as text.
    """
    kinds = {"rid": pa.int64(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(),
             "groups_sha256": pa.string(), "pairs": pa.binary(), "links": pa.binary(), "groups": pa.string()}
    schema = pa.schema(list(kinds.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rid = Units(pair_of(name_a, name_b)), TaskContext.get().partitionId() << 33
        for batch in batches:
            measures, waiting, size = [], [], 0

            def settle_waiting() -> None:
                known.learn()
                for measure, at in waiting:
                    measure.add_numbers(known, at)
                waiting.clear()
                if known.full():
                    known.forget()

            for text in batch.column("text").to_pylist():
                measures.append(Measure(keep_groups))
                for stretch in stretches(" " + text) if text else ():
                    waiting.append((measures[-1], known.numbers(units(stretch))))
                    size += len(stretch)
                    if size > STRETCH:
                        settle_waiting()
                        size = 0
            settle_waiting()
            rows = [(rid + i, doc, *m.row()) for i, (doc, m) in enumerate(zip(batch.column("doc_id").to_pylist(), measures))]
            rid += len(rows)
            yield pa.RecordBatch.from_pydict(dict(zip(kinds, map(list, zip(*rows)))) if rows else {c: [] for c in kinds}, schema=schema)

    ddl = ("rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "pairs binary, links binary, groups string")
    made = texts(docs).mapInArrow(run, ddl)
    return written(made if keep_groups else made.drop("groups"))


def pair_counts(aligned: DataFrame, flush: int = 1_000_000) -> DataFrame:
    """How many documents hold each id pair linked, and whether that is the most of its first id: ``pair, n, best``."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, loose = np.zeros(0, np.uint32), np.zeros(0, np.int64), []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            more = np.concatenate([keys, *loose])
            return distinct(more, np.concatenate([counts, np.ones(len(more) - len(keys), np.int64)]))

        for batch in batches:
            loose += [np.frombuffer(x, "<u4") for x in batch.column("pairs").to_pylist()]
            if sum(map(len, loose)) > flush:
                keys, counts = merged()
                loose = []
                if len(keys) > flush:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], schema=schema)
                    keys, counts = keys[:0], counts[:0]
        keys, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], schema=schema)

    counts = written(aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    counts = counts.withColumn("a", F.shiftright("pair", 16))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of one vocabulary at most
    return counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, name_a: str = "byte_bpe_50k.json", name_b: str = "piece_bpe_32k.model", head: int = 300_000,
          keep_groups: bool = False) -> DataFrame:
    """Aligns the tokens of a byte-level BPE (A) and a SentencePiece model (B), and scores the links.

    A encodes a space and the text, B the text (it adds the space itself); special strings are plain text. Where tokens of
    both end at the same byte a group ends. Every A token of a group is linked with every B token
    of it. A pair of ids counts the documents that hold it linked.

    Returns a row for each row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links``, ``n_best`` (links
    whose pair counts as much as any of its A id), ``count_sum`` (counts added over the links),
    ``groups_sha256``, and with ``keep_groups`` the ``groups`` as text (``a1,a2|b1;a3|b2``).

    Units between spaces are encoded once for each task that meets them; texts are read in stretches, so memory
    is bounded by the cache and one batch. Each document's distinct pairs are written once. The
    ``head`` most frequent pairs (17 bytes each) go to every task; the others are joined by shuffle. A
    group costs the product of its distinct ids.

    Null and empty texts, and texts whose bytes do not come back from both tokenizers, have no tokens:
    zeros and an empty string. Repeated rows are each returned and counted each; an empty table gives no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    aligned = groups_by_document(docs, name_a, name_b, keep_groups)
    counts = written(pair_counts(aligned))
    top = counts.orderBy(F.desc("n"), "pair").limit(head).toArrow()
    order = np.argsort(np.asarray(top.column("pair")))
    shared = spark.sparkContext.broadcast(tuple(np.asarray(top.column(c))[order] for c in ("pair", "n", "best")))
    sizes = ["n_a", "n_b", "n_groups", "n_links"]
    kinds = {c: pa.int64() for c in ("rid", "doc_id", *sizes)} | {"groups_sha256": pa.string()} | {c: pa.int64() for c in ("pair", "times", "head_sum", "head_best")}
    schema = pa.schema(list(kinds.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for batch in batches:
            rid = np.asarray(batch.column("rid"))
            parts = [np.frombuffer(x, "<u4") for x in batch.column("pairs").to_pylist()]
            keys = np.concatenate([*parts, np.zeros(0, np.uint32)]).astype(np.int64)
            links = np.concatenate([np.frombuffer(x, "<i8") for x in batch.column("links").to_pylist()] + [np.zeros(0, np.int64)])
            ends = np.cumsum([0] + [len(p) for p in parts])
            at = np.minimum(np.searchsorted(pairs, keys), max(len(pairs) - 1, 0))
            known = pairs[at] == keys if len(pairs) else np.zeros(len(keys), bool)
            sums = []
            for weight in (n, best.astype(np.int64)):
                total = np.r_[0, np.cumsum(np.where(known, links * weight[at] if len(pairs) else 0, 0))]
                sums.append(total[ends[1:]] - total[ends[:-1]])
            own = {c: batch.column(c) for c in ("rid", "doc_id", *sizes, "groups_sha256")}
            # A document's own row; its pair is one that no two rows share.
            yield pa.RecordBatch.from_pydict(own | {"pair": -1 - rid, "times": np.zeros(len(rid), np.int64), "head_sum": sums[0], "head_best": sums[1]}, schema=schema)
            rest = np.flatnonzero(~known)
            if len(rest):
                of = rid[np.searchsorted(ends, rest, side="right") - 1]
                yield pa.RecordBatch.from_pydict({c: pa.nulls(len(rest), t) for c, t in kinds.items()} | {"rid": of, "pair": keys[rest], "times": links[rest]}, schema=schema)

    ddl = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in kinds)
    parts = aligned.select("rid", "doc_id", *sizes, "groups_sha256", "pairs", "links").mapInArrow(run, ddl)
    out = (parts.join(counts, "pair", "left").groupBy("rid").agg(
        *[F.max(c).alias(c) for c in ("doc_id", *sizes, "groups_sha256")],
        (F.sum(F.col("times") * F.when(F.col("best"), 1).otherwise(0)) + F.max("head_best")).alias("n_best"),
        (F.sum(F.col("times") * F.coalesce("n", F.lit(0))) + F.max("head_sum")).alias("count_sum")))
    if keep_groups:
        out = out.join(aligned.select("rid", "groups"), "rid")
    return out.select("doc_id", *sizes, "n_best", "count_sum", "groups_sha256", *["groups"] * keep_groups)
