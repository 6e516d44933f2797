"""Token counts without token ids: pieces are counted once for each distinct pre-token."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineside.llm.tables import text_key, texts
from lineside.session import settle

# The tokenizer's own pre-token pattern and its special strings.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")

#: Texts made of these only are normalised by lower-casing alone; others go through the tokenizer's normaliser.
_PLAIN = regex.compile(r"[\x00-ɏ‐-‧‰-⁞₠-₿]*")
#: White space of the tokenizer; Python's own also holds the four separators below.
_SPACE = "\\t-\\r \x85\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_PIECES = regex.compile(PRE_TOKEN.replace(r"\s", _SPACE))
_WORDS = regex.compile(f"[^{_SPACE}]+")
_SPECIAL = regex.compile("|".join(map(regex.escape, SPECIAL)))
_loaded: dict[str, object] = {}


def tokenizer_path(name: str) -> str:
    """A file of the installed tokenizers by name; anything with a slash is a path already."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(name: str):
    """The tokenizer, read once in each Python worker."""
    if name not in _loaded:
        from tokenizers import Tokenizer

        _loaded[name] = Tokenizer.from_file(tokenizer_path(name))
    return _loaded[name]


def pre_tokens(word: str, name: str) -> list[str]:
    """Pre-tokens of a word (no white space, no special string within)."""
    if _PLAIN.fullmatch(word):
        return _PIECES.findall(word.lower())
    # Its letter classes may be of another Unicode version than Python's: the tokenizer cuts these itself.
    normal = tokenizer(name).normalizer.normalize_str(word)
    return [normal[a:b] for _, (a, b) in tokenizer(name).pre_tokenizer.pre_tokenize_str(normal)]


def split_words(text: str) -> list[str]:
    """Words between the tokenizer's white space."""
    return _WORDS.findall(text) if any(c in text for c in _SEPARATORS) else text.split()


def words_and_specials(text: str) -> tuple[list[str], int]:
    """Words between white space, as no pre-token crosses it, and how often special strings occur."""
    if "<|" not in text:
        return split_words(text), 0
    parts = _SPECIAL.split(text)
    return [w for part in parts for w in split_words(part)], len(parts) - 1


def piece_counts(pieces: list[str], name: str) -> list[int]:
    """How many tokens each pre-token makes."""
    return [len(ids) for ids in piece_ids(pieces, name)]


def piece_ids(pieces: list[str], name: str) -> list[list[int]]:
    """The ids of each pre-token: plain ones in one call, as they stay whole between blanks, others one by one."""
    plain = [i for i, p in enumerate(pieces) if _PLAIN.fullmatch(p)]
    ids: list[list[int]] = [[] for _ in pieces]
    alone = sorted(set(range(len(pieces))) - set(plain))
    if plain:
        made = tokenizer(name).encode(" ".join(pieces[i] for i in plain), add_special_tokens=False)
        if len(set(made.word_ids)) == len(plain):
            for i, word in zip(made.ids, made.word_ids):
                ids[plain[word]].append(i)
        else:
            alone = list(range(len(pieces)))
    for i, made in zip(alone, tokenizer(name).encode_batch([pieces[i] for i in alone], add_special_tokens=False)):
        ids[i] = made.ids
    return ids


class _Weights(dict):
    """Word -> tokens of its pre-tokens in ``head``; the others stand in ``rest``, by word."""

    def __init__(self, head: dict[str, int], name: str, most: int = 200_000):
        self.head, self.name, self.most, self.rest = head, name, most, {}

    def __missing__(self, word: str) -> int:
        known, other = 0, []
        for piece in pre_tokens(word, self.name):
            if piece in self.head:
                known += self.head[piece]
            else:
                other.append(piece)
        self[word] = known
        if other:
            self.rest[word] = other
        return known

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()
            self.rest.clear()


def pre_token_frequencies(docs: DataFrame, name: str, flush: int = 200_000) -> DataFrame:
    """How often each pre-token occurs over all documents: ``piece``, ``n``. Batches are added up first."""
    schema = pa.schema([("piece", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def flushed() -> Iterator[pa.RecordBatch]:
            pieces: Counter = Counter()
            for word, n in words.items():
                for piece in pre_tokens(word, name):
                    pieces[piece] += n
            words.clear()
            yield pa.RecordBatch.from_pydict({"piece": list(pieces), "n": list(pieces.values())}, schema=schema)

        for batch in batches:
            for text in batch.column("text").to_pylist():
                words.update(words_and_specials(text or "")[0])
                if len(words) > flush:
                    yield from flushed()
        yield from flushed()

    return (docs.select("text").mapInArrow(run, "piece string, n long")
            .groupBy("piece").agg(F.sum("n").alias("n")))


def count_pieces(pieces: DataFrame, name: str) -> DataFrame:
    """Adds ``tokens`` to rows of distinct ``piece``."""
    schema = pa.schema([("piece", pa.string()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("piece").to_pylist()
            yield pa.RecordBatch.from_pydict({"piece": found, "tokens": piece_counts(found, name)}, schema=schema)

    return pieces.select("piece").mapInArrow(run, "piece string, tokens long")


def token_counts(docs: DataFrame, name: str = "word_bpe_49k.json", limit: int = 2048,
                 head: int = 100_000, head_chars: int = 64) -> DataFrame:
    """Tokens of every document: ``doc_id, n_bytes, n_tokens, over_limit``, a row for each row of ``docs``.

    Pre-tokens are counted over all documents; pieces are counted once for each distinct one. The
    ``head`` most frequent (of at most ``head_chars`` characters, so at most head x head_chars
    characters in all) go to every task and are joined there. All others are joined by a shuffle
    on the pre-token, to one row for each document and pre-token that is not in the head. Ids are
    never laid out. Null and empty texts have 0 bytes and 0 tokens; repeated rows are each
    returned; an empty table gives no rows; other columns are not read.
    """
    spark, name_of = docs.sparkSession, name
    rows = texts(docs).select("doc_id", F.col("text"), text_key().alias("k"))
    seen = settle(pre_token_frequencies(rows, name))
    top = seen.where(F.length("piece") <= head_chars).orderBy(F.desc("n"), "piece").limit(head).select("piece")
    known = {r.piece: r.tokens for r in count_pieces(top, name).collect()}
    shared = spark.sparkContext.broadcast(known)
    counted = count_pieces(seen.where(F.col("n") > 0), name)
    schema = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("n_bytes", pa.int64()), ("piece", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(shared.value, name_of)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in schema.names}

            def put(*row) -> None:
                for column, value in zip(out.values(), row):
                    column.append(value)

            for doc, k, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "k", "text"))):
                words, specials = words_and_specials(text or "")
                total = sum(map(weights.__getitem__, words)) + specials
                other: Counter = Counter()
                if weights.rest:
                    for word in filter(weights.rest.__contains__, words):
                        other.update(weights.rest[word])
                # The document's own row; no pre-token has a digit next to another character.
                put(doc, k, len((text or "").encode("utf-8", "surrogatepass")), f"\x000{k}", total)
                for piece, n in other.items():
                    put(doc, k, None, piece, n)
                weights.trim()
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    parts = rows.mapInArrow(run, "doc_id long, k long, n_bytes long, piece string, n long")
    totals = (parts.join(counted, "piece", "left")
              .groupBy("doc_id", "k").agg(
                  F.sum(F.col("n") * F.coalesce("tokens", F.lit(1))).alias("all_tokens"),
                  F.count("n_bytes").alias("copies"), F.max("n_bytes").alias("n_bytes")))
    return (totals.select("doc_id", "n_bytes", F.expr("all_tokens div copies").alias("n_tokens"),
                          F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
