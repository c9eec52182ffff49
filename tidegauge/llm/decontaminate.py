"""Benchmark decontamination by templates, in DataFrame functions only.

Numbers, units behind numbers, and capitalised words (names) of a text become typed
placeholders; what is left are lower-case words. Windows of the documents' templates are
joined by hash with those of the benchmark's items. A match names an alignment of an item
with a place of a document; there the whole item is compared word by word, runs of
``WINDOW`` equal words count, and each value of the item must stand for one value of the
document, so a question with other numbers or names is found, also where new values
coincide. The words of a slot whose item value stands for several values here break the
runs, unless they are as in the item: what is verbatim counts whatever else is edited,
while a text that fills the slots at random falls apart.

Both sides take all windows, so any stretch of ``WINDOW`` template words that a document
shares with an item is aligned, if some window in it has ``LITERALS`` plain words. A document
leaks an item if the aligned stretches hold ``least_share`` of the item's words.

Defined results: null and empty texts neither leak nor are leaked; items under ``WINDOW``
words, or without a window of ``LITERALS`` plain words, cannot be told from chance and take
no part; repeated items and rows count once; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import stored

WINDOW = 8
LITERALS = 5
LEAST_SHARE = 0.6
# Item windows, of 40 bytes each, up to which they are sent to all executors.
BROADCAST_WINDOWS = 500_000

# Units of measure, as words behind a number.
UNITS = (
    "km m cm mm mi ft in yd kg g mg lb lbs oz l ml cl s sec min h hr hrs kmh mph percent "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters "
    "mile miles foot feet inch inches yard yards gram grams kilogram kilograms pound pounds ounce "
    "ounces liter liters litre litres gallon gallons dollar dollars euro euros cent cents degree degrees"
).split()

NUMBER_MARK, UNIT_MARK, NAME_MARK = "\ue001", "\ue002", "\ue003"
MARKS = NUMBER_MARK + UNIT_MARK + NAME_MARK
# Possessive: the groups of a number are never given back, and a list of numbers as long as a
# text costs the matcher no stack.
_NUMBER = r"\p{N}++(?:[.,]\p{N}++)*+"
# Looked for from the start of a number only, so that a list is read once.
_UNIT = rf"(?<!\p{{N}})(?<!\p{{N}}[.,])({_NUMBER})\s*(?i:{'|'.join(UNITS)})(?![\p{{L}}\p{{M}}])"
_NAME = r"(?<![\p{L}\p{M}])\p{Lu}[\p{Ll}\p{M}]+(?![\p{L}\p{M}])"
_WORDS = rf"[\p{{L}}\p{{M}}]+|[{MARKS}]"
_VALUES = rf"{_NUMBER}|[\p{{L}}\p{{M}}]+"


def _plain(text: Column) -> Column:
    return F.translate(text, MARKS, "")


def template(text: Column) -> Column:
    """The words of a text, lower-cased, with placeholders for numbers, units and names."""
    marked = F.regexp_replace(_plain(text), _UNIT, f" {NUMBER_MARK} {UNIT_MARK} ")
    marked = F.regexp_replace(marked, _NUMBER, f" {NUMBER_MARK} ")
    marked = F.regexp_replace(marked, _NAME, NAME_MARK)
    return F.regexp_extract_all(F.lower(marked), F.lit(_WORDS), F.lit(0))


def values(text: Column) -> Column:
    """The words and numbers of a text as they are, in step with its template."""
    return F.regexp_extract_all(_plain(text), F.lit(_VALUES), F.lit(0))


def _windows(words: Column) -> Column:
    """Structs of position and hash of every window."""
    last = F.size(words) - WINDOW
    found = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(words, i + 1, WINDOW)).alias("hash")),
    )
    return F.when(last >= 0, found).otherwise(F.array().cast("array<struct<at:int,hash:bigint>>"))


def _is_literal(word: Column) -> Column:
    return ~word.isin(*MARKS)


def items_of(benchmark: DataFrame, text: str, id_column: str) -> DataFrame:
    """Items with ``words`` and ``values``; of equal ids and texts one."""
    named = benchmark.select(F.col(id_column).alias("item_id"), F.col(text).cast("string").alias("item_text"))
    named = named.filter("item_text is not null").distinct()
    words, own = template(F.col("item_text")).alias("words"), values(F.col("item_text")).alias("values")
    found = named.select("item_id", F.xxhash64("item_id", "item_text").alias("item_key"), words, own)
    return found.filter(F.size("words") >= WINDOW)


def _item_windows(items: DataFrame) -> DataFrame:
    at = F.explode(_windows(F.col("words"))).alias("w")
    rows = items.select("item_key", "words", F.size("words").alias("n_item"), at)
    literals = F.size(F.filter(F.slice("words", F.col("w.at") + 1, WINDOW), _is_literal))
    return rows.filter(literals >= LITERALS).select("item_key", "n_item", F.col("w.at").alias("item_at"), F.col("w.hash").alias("hash"))


def _long_runs(at: Column) -> Column:
    """Of sorted positions those in runs of ``WINDOW`` or more."""
    starts = F.filter(at, lambda p, i: F.get(at, i + WINDOW - 1) == p + WINDOW - 1)
    return F.array_distinct(F.flatten(F.transform(starts, lambda p: F.sequence(p, p + WINDOW - 1))))


def _keys(id_column: str, text: str) -> list[Column]:
    """What tells rows apart: two non-null hashes of id and text."""
    return [F.xxhash64(id_column, text).alias("key_"), F.crc32(F.col(text).cast("binary")).alias("crc_")]


def leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    least_share: float = LEAST_SHARE,
) -> DataFrame:
    """Pairs of document and benchmark item that the document leaks.

    Columns: the document's id and ``doc_hash``, ``item_id``, ``n_item`` (words of the item),
    ``share`` of them found, ``n_slots`` among these (of the alignment with most), and
    ``verbatim`` (an alignment has equal values in all slots).
    """
    texts = documents.select(F.col(id_column), F.col(text).cast("string").alias("text")).filter("text is not null")
    items = stored(items_of(benchmark, item_text, item_id), "benchmark-items")
    marks = stored(_item_windows(items), "benchmark-windows")
    small = marks.count() <= BROADCAST_WINDOWS
    keyed = texts.select(*_keys(id_column, "text"), template(F.col("text")).alias("words"))
    windows = keyed.select("key_", "crc_", F.explode(_windows(F.col("words"))).alias("w")).select(
        "key_", "crc_", F.col("w.at").alias("doc_at"), F.col("w.hash").alias("hash")
    )
    hits = windows.join(F.broadcast(marks) if small else marks, "hash").select(
        "key_", "crc_", "item_key", "n_item", (F.col("doc_at") - F.col("item_at")).alias("shift")
    )
    places = stored(
        hits.groupBy("key_", "crc_").agg(F.collect_set(F.struct("item_key", "n_item", "shift")).alias("places")), "benchmark-hits"
    )
    found = texts.select(id_column, "text", *_keys(id_column, "text")).join(places, ["key_", "crc_"])
    found = found.withColumn("words", template(F.col("text"))).withColumn("values", values(F.col("text")))
    first = lambda place: F.greatest(place["shift"], F.lit(0))
    ours = lambda column, place: F.slice(column, first(place) + 1, place["n_item"] + place["shift"] - first(place))
    cut = F.explode(
        F.transform(
            "places",
            lambda p: F.struct(
                p["item_key"].alias("item_key"),
                p["shift"].alias("shift"),
                F.greatest(-p["shift"], F.lit(0)).alias("from"),
                ours(F.col("words"), p).alias("words"),
                ours(F.col("values"), p).alias("values"),
            ),
        )
    )
    aligned = found.select(id_column, "key_", "crc_", cut.alias("ours")).select(id_column, "key_", "crc_", "ours.*")
    theirs = items.join(marks.select("item_key").distinct(), "item_key", "left_semi")
    theirs = theirs.select("item_id", "item_key", F.col("words").alias("item_words"), F.col("values").alias("item_values"))
    both = aligned.join(F.broadcast(theirs) if small else theirs, "item_key")
    # For each word of the stretch 1 if it agrees, then 0 again in runs that are too short.
    agrees = F.transform(
        "words", lambda word, j: F.when(word == F.get("item_words", j + F.col("from")), "1").otherwise("0")
    )
    runs = F.transform(
        F.split(F.array_join(agrees, ""), "0", -1),
        lambda run: F.when(F.length(run) >= WINDOW, run).otherwise(F.repeat(F.lit("0"), F.length(run))),
    )
    marked = both.withColumn("marks", F.array_join(runs, "0"))
    agreeing = F.filter(
        F.transform(
            "words",
            lambda word, j: F.struct(
                (j + F.col("from")).alias("at"),
                word.alias("word"),
                F.substring(F.col("marks"), j + 1, F.lit(1)).alias("mark"),
                F.get("item_values", j + F.col("from")).alias("theirs"),
                F.get("values", j).alias("ours"),
            ),
        ),
        lambda x: x["mark"] == "1",
    )
    key = [id_column, "key_", "crc_", "item_id", "item_key"]
    rows = marked.select(*key, "shift", F.size("item_words").alias("n_item"), F.explode(agreeing).alias("x"))
    alignments = rows.groupBy(*key, "n_item", "shift").agg(F.sort_array(F.collect_set("x")).alias("agreeing"))
    slot = lambda x: F.struct(x["word"].alias("word"), x["theirs"].alias("theirs"), x["ours"].alias("ours"))
    in_slots = F.filter("agreeing", lambda x: ~_is_literal(x["word"]))
    alignments = alignments.withColumn("slots", F.array_distinct(F.transform(in_slots, slot)))
    # Words in slots whose item value stands for several values here, unless they are as in the item.
    torn = lambda x: (x["theirs"] != x["ours"]) & F.exists(
        "slots", lambda s: (s["word"] == x["word"]) & (s["theirs"] == x["theirs"]) & (s["ours"] != x["ours"])
    )
    sound = F.filter("agreeing", lambda x: _is_literal(x["word"]) | ~torn(x))
    counted = _long_runs(F.transform(sound, lambda x: x["at"]))
    alignments = alignments.withColumn("at", counted).filter(F.size("at") > 0)
    in_runs = F.filter("agreeing", lambda x: ~_is_literal(x["word"]) & F.array_contains("at", x["at"]))
    judged = alignments.groupBy(*key, "n_item").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("found"),
        F.max(F.size(F.array_distinct(F.transform(in_runs, slot)))).alias("n_slots"),
        F.max(F.forall("slots", lambda s: s["theirs"] == s["ours"])).alias("verbatim"),
    )
    share = F.col("found") / F.col("n_item")
    return judged.filter(share >= least_share).select(
        id_column, F.col("key_").alias("doc_hash"), "item_id", "n_item", share.alias("share"), "n_slots", "verbatim"
    )


def without_leaks(documents: DataFrame, benchmark: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The documents that leak no item, with all columns; null texts stay."""
    found = leaks(documents, benchmark, text, id_column).select(F.col("doc_hash").alias("leak__")).distinct()
    marked = stored(found, "leaks")
    return documents.join(marked, F.xxhash64(id_column, F.col(text).cast("string")) == F.col("leak__"), "left_anti")
