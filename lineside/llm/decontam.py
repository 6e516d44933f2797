"""Benchmark decontamination by template windows, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineside.llm.tables import text_key, texts
from lineside.session import settle

WINDOW, LEAST_WINDOW = 8, 5
#: Windows with fewer literal words than half say too little.
LITERAL_SHARE = 0.5
#: Benchmark windows up to this number are sent to every task; above it the join is by shuffle.
BROADCAST_WINDOWS = 200_000
# Measures that follow a number.
UNITS = ("percent km m cm mm mi mile miles ft feet foot inch inches yd kg g mg lb lbs pound pounds oz ton tons l ml liter liters litre "
         "litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
         "usd eur euro euros dollar dollars cent cents mph kmh hz khz mhz ghz w kw v a kb mb gb tb c f k").split()

_NUMBER = "[0-9]+(?:[.,][0-9]+)*"
#: Marks of the three kinds of slots; they stand before the value that they type.
_KINDS = ("\x01", "\x02", "\x03")
#: The mark of a name that may only be the start of a sentence; its placeholder is that of a name.
_HEAD = "\x04"


def _tokens(text: Column) -> Column:
    """Lower-case words and numbers; a number, a unit and a name begin with the mark of their kind.

    A unit stands right after a number. Any word with a capital counts as a name; those that do not
    follow a white space character and, before it, something else than the end of a sentence are
    marked apart, as they may be no more than the start of a sentence.
    """
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{Lu}(?<=[^.!?\s]\s\p{Lu})\p{L}*", _KINDS[1] + "$0")
    marked = F.regexp_replace(marked, rf"(?<![\p{{L}}{_KINDS[1]}])\p{{Lu}}\p{{L}}*", _HEAD + "$0")
    marked = F.regexp_replace(marked, rf"({_NUMBER})\s?({'|'.join(UNITS)})(?!\p{{L}})", rf"$1 {_KINDS[2]}$2")
    marked = F.regexp_replace(marked, _NUMBER, _KINDS[0] + "$0")
    return F.regexp_extract_all(F.lower(marked), F.lit(rf"{_KINDS[0]}[0-9.,]*[0-9]|[{_KINDS[1]}{_KINDS[2]}{_HEAD}]?\p{{L}}+"), F.lit(0))


def _template(raw: Column) -> Column:
    """A typed placeholder for each slot, the hash of any other word."""
    return F.transform(raw, lambda x: F.when(x < "\x05", F.when(x.startswith(_HEAD), 2).otherwise(F.ascii(x)).cast("long")).otherwise(F.xxhash64(x)))


def _starts(size: Column) -> Column:
    return F.when(F.size("t") >= size, F.sequence(F.lit(1), F.size("t") - size + 1)).otherwise(F.array().cast("array<int>"))


def _hashes(size: int) -> Column:
    """The template hash of every window."""
    return F.transform(_starts(F.lit(size)), lambda i: F.xxhash64(F.slice("t", i, size)))


def _windows(size: Column) -> Column:
    """Every window of ``size`` tokens: where it starts, the hash of its template, its words."""
    return F.transform(_starts(size), lambda i: F.struct(
        i.alias("pos"), F.xxhash64(F.slice("t", i, size)).alias("h"), F.slice("raw", i, size).alias("words")))


def _plain(raw: Column) -> Column:
    """The words and values without marks, told apart from templates."""
    return F.concat(F.array(F.lit(0).cast("long")), F.transform(raw, lambda x: F.xxhash64(F.regexp_replace(x, "^[\x01-\x04]", ""))))


def _exact(size: int) -> Column:
    """The hash of the plain words of every window."""
    return F.transform(_starts(F.lit(size)), lambda i: F.xxhash64(F.lit("exact"), F.slice("e", i + 1, size)))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Windows of each item: ``item_id, size, exact, pos, h, words, n_templates, n_windows``.

    Items of less than eight tokens are one window. Windows of which less than half are literal words,
    and items of less than five tokens, are met by their exact words and values only.
    """
    items = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), _tokens(F.col("text").cast("string")).alias("raw"))
             .where((F.size("raw") > 0) & F.col("item_id").isNotNull()).distinct()
             .withColumns({"t": _template(F.col("raw")), "e": _plain(F.col("raw")), "size": F.least(F.size("raw"), F.lit(window))}))
    literal = F.size(F.filter("words", lambda w: w >= "\x05")) >= LITERAL_SHARE * F.col("size")
    rows = (items.select("item_id", "size", "e", F.inline(_windows(F.col("size"))))
            .withColumn("exact", ~literal | (F.col("size") < LEAST_WINDOW))
            .withColumn("h", F.when(F.col("exact"), F.xxhash64(F.lit("exact"), F.slice("e", F.col("pos") + 1, F.col("size")))).otherwise(F.col("h")))
            .drop("e"))
    counts = rows.groupBy("item_id").agg(F.countDistinct(F.when(~F.col("exact"), F.col("pos"))).alias("n_templates"), F.countDistinct("pos").alias("n_windows"))
    return rows.join(counts, "item_id")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_cover: float = 0.5) -> DataFrame:
    """Documents that hold benchmark items, also with other numbers, names and units.

    Returns a row for each document that holds one: ``doc_id, k`` (a key of the text)``, item_ids,
    n_items, cover`` (the largest share of an item's windows) and ``reworded`` (some item has other
    values in its slots). Windows of documents meet those of the benchmark by hash; documents with a
    match are read again with their words, which keeps words out of the large pass. Within the
    matches of an item at one alignment, a window counts if each value of the item stands for the
    value it most often stands for in the document, or if all its values are the same; two values of
    the item may stand for one. Where an alignment gives a name two values, only the windows whose
    values are all the same count; words that may only start a sentence are judged per window. An item is held when consistent matches cover at
    least ``least_cover`` of its template windows, or of all its windows, exact ones included.

    A null text holds nothing; rows that repeat doc_id and text give one row; empty tables give no
    rows; other columns are not read. The benchmark may be of any size: only up to 200,000 windows
    are broadcast.
    """
    marks = benchmark_windows(benchmark, window)
    sizes = [(r["size"], r["exact"]) for r in marks.select("size", "exact").distinct().orderBy("size", "exact").collect()]  # 1 to 8 only
    few = marks.count() <= BROADCAST_WINDOWS
    read = texts(docs).select("doc_id", text_key().alias("k"), "text")

    def laid(rows: DataFrame) -> DataFrame:
        return (rows.select("doc_id", "k", _tokens(F.col("text")).alias("raw"))
                .withColumns({"t": _template(F.col("raw")), "e": _plain(F.col("raw"))}))

    def windows(size: int, exact: bool) -> Column:
        hashed = (lambda i: F.xxhash64(F.lit("exact"), F.slice("e", i + 1, size))) if exact else (lambda i: F.xxhash64(F.slice("t", i, size)))
        return F.transform(_starts(F.lit(size)), lambda i: F.struct(i.alias("at"), hashed(i).alias("h"), F.slice("raw", i, size).alias("dwords")))

    def sent(own: DataFrame) -> DataFrame:
        return F.broadcast(own) if few else own

    # A text is cut into words once; the windows of all sizes are laid side by side and meet one table of hashes.
    sizes = sizes or [(window, False)]
    hashes = F.concat(*(_exact(n) if exact else _hashes(n) for n, exact in sizes))
    hit = laid(read).select("doc_id", "k", F.explode(hashes).alias("h")).join(sent(marks.select("h").distinct()), "h", "left_semi")
    hit = settle(hit.groupBy(F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("k").alias("key")).agg(F.count("*").alias("n")))
    near = read.join(hit, (F.coalesce("doc_id", F.lit(-1)) == F.col("id")) & (F.col("k") == F.col("key")), "left_semi")
    items = marks.select("h", "item_id", "exact", "n_templates", "n_windows", F.col("pos").alias("ipos"), F.col("words").alias("iwords"))
    matches = laid(near).select("doc_id", "k", F.inline(F.concat(*(windows(n, exact) for n, exact in sizes)))).join(sent(items), "h")

    def value(word: Column) -> Column:
        return F.when(word.startswith(_HEAD), F.concat(F.lit(_KINDS[1]), F.substring(word, 2, 1 << 30))).otherwise(word)

    pairs = F.filter(F.transform("iwords", lambda w, i: F.when(~F.col("exact") & (w < "\x05"), F.struct(
        value(w).alias("item"), value(F.get("dwords", i)).alias("doc"), w.startswith(_KINDS[1]).alias("sure"), (F.col("ipos") + i).alias("slot")))), lambda s: s.isNotNull())
    alignment = ["doc_id", "k", "item_id", "shift"]
    met_windows = settle(matches.select("doc_id", "k", "item_id", "exact", "n_templates", "n_windows", "ipos", (F.col("at") - F.col("ipos")).alias("shift"), pairs.alias("pairs")))
    images = (met_windows.select(*alignment, F.inline("pairs")).distinct().groupBy(*alignment, "item", "doc")
              .agg(F.count("*").alias("n"), F.max("sure").alias("sure"))
              .groupBy(*alignment, "item").agg(F.sum(F.col("sure").cast("int")).alias("n_sure"), F.max(F.struct("n", F.col("item") == F.col("doc"), "doc")).alias("best"))
              .groupBy(*alignment).agg(F.collect_list(F.struct("item", "best.doc")).alias("map"),
                                       F.max(F.col("n_sure") > 1).alias("split"))
              .withColumnsRenamed({c: f"_{c}" for c in alignment}))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in alignment]
    same = F.forall("pairs", lambda s: s.item == s.doc)
    usual = F.forall("pairs", lambda s: F.exists("map", lambda m: (m.item == s.item) & (m.doc == s.doc)))
    held = (met_windows.join(images, on, "left").where(same | (~F.coalesce("split", F.lit(False)) & usual))
            .withColumn("changed", F.exists("pairs", lambda s: s.item != s.doc))
            .groupBy("doc_id", "k", "item_id")
            .agg(F.greatest(F.countDistinct(F.when(~F.col("exact"), F.col("ipos"))) / F.when(F.max("n_templates") > 0, F.max("n_templates")),
                            F.countDistinct("ipos") / F.max("n_windows")).alias("cover"), F.max("changed").alias("changed"))
            .where(F.col("cover") >= least_cover))
    return (held.groupBy("doc_id", "k")
            .agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.count("*").alias("n_items"),
                 F.max("cover").alias("cover"), F.max("changed").alias("reworded")))
