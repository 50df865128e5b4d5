"""Benchmark decontamination by template canonicalisation.

Words of texts and benchmark items are lower-cased and stripped of outer punctuation; numbers, names (a capitalised word
inside a sentence) and units (after a number) become typed placeholders. Windows of `WIDTH` such tokens are hashed and
joined. A text holds an item if an occurrence has `coverage` of the item's windows, and its slots are consistent: within it, a
value of the item stands for one value of the text everywhere, and no two values for the same, so that a question with other
numbers or names is caught and chance meetings of placeholders aren't. Occurrences are local. They are told apart by alignment
(place in the text less place in the item): each alignment by itself, and alignments that differ by half an item at most (words
put in or left out).

Windows come in three forms: with all placeholders; with those of numbers and units only, names being plain words (for languages that
capitalise nouns, and texts in lower case); and of the plain words themselves, so that a verbatim copy always counts. Of windows with
placeholders, those with fewer than two plain words are not used. An item shorter than `WIDTH` words is one window of its own length.
Null and empty texts and items match nothing. Items with the same words are each reported. Keys may repeat: their
rows are told apart by a hash of the text. Extra columns don't pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoplate.llm.common import slices, written
from chronoplate.llm.minhash import mixed

WIDTH = 5
#: Words that a task remembers (some 100 MB at most).
KNOWN = 600_000
#: Benchmark windows that may be broadcast; more are joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000
#: Bits of the filter that scans look windows up in before the join: 256 for each benchmark window, up to 2^26 (8 MB packed).
FILTER_BITS = range(16, 27)

PLAIN, NUMBER, UNIT, NAME = range(4)

#: Units of measure and currency.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months "
    "year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet gram grams kilogram kilograms pound "
    "pounds liter liters litre litres degree degrees percent % ° °c °f $ € £ usd eur gbp dollar dollars euro euros cent cents kb mb gb tb hz khz mhz ghz "
    "w kw mw v a j kj cal kcal pa kpa bar mph km/h m/s".split()
)
_EDGES = "".join(c for c in map(chr, range(33, 127)) if not (c.isalnum() or c in "_$%+-")) + "“”‘’«»¿¡…"
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?(?:st|nd|rd|th)?")
_GLUED = re.compile(r"[+-]?\d[\d.,]*([^\W\d]{1,3})")
_QUOTES = "'\")]”’»"

_U = np.uint64
_CODES = {k: _U(xxhash.xxh3_64_intdigest(f"\0{k}".encode()) & ~7) for k in (NUMBER, UNIT, NAME)}


class Tokens(dict):
    """Words as numbers: a hash of the plain word with the kind in the low two bits and bit 2 set where a sentence ends."""

    def __missing__(self, word: str) -> int:
        ends = 4 if word.rstrip(_QUOTES)[-1:] in (".", "!", "?", ":") else 0
        plain = word.strip(_EDGES)
        low, head = plain.lower(), plain[:1]
        kind = PLAIN
        if low in UNITS:
            kind = UNIT
        elif head.isalpha():
            if head.isupper() and plain[1:].islower():
                kind = NAME
        elif _NUMBER.fullmatch(low) or ((m := _GLUED.fullmatch(low)) and m[1] in UNITS):
            kind = NUMBER
        code = (xxhash.xxh3_64_intdigest(low.encode()) & ~7) | ends | kind
        if len(word) <= 64:
            if len(self) >= KNOWN:
                self.clear()
            self[word] = code
        return code


FULL, NUMERIC, WORDS = range(3)


def canonical(words: list[str], known: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(raw codes, where numbers and units stand, where names stand) of a text's words."""
    raw = np.fromiter(map(known.__getitem__, words), _U, len(words))
    kind = raw & _U(3)
    if not kind.any():
        none = np.zeros(len(raw), bool)
        return raw, none, none
    starts = np.concatenate([[True], (raw[:-1] & _U(4)) > 0])
    number = kind == NUMBER
    unit = (kind == UNIT) & np.concatenate([[False], number[:-1]])
    return raw, number | unit, (kind == NAME) & ~starts


def forms(raw: np.ndarray, amounts: np.ndarray, names: np.ndarray, width: int, every: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(form, slots, starts, hashes) of a text's windows. A form leaves out windows that another form gives the same hash, unless `every` is asked for."""
    n = len(raw) - width + 1
    if n <= 0:
        return
    plain = raw & ~_U(7)
    inside = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[width:] - c[:-width]
    amount, name = (inside(x) if x.any() else None for x in (amounts, names))
    codes = plain
    if amount is not None:
        codes = np.where(amounts, np.where((raw & _U(3)) == NUMBER, _CODES[NUMBER], _CODES[UNIT]), plain)
    if amount is not None and name is not None:
        at = np.arange(n) if every else np.flatnonzero((amount > 0) & (name > 0))
        at = at[width - amount[at] >= min(2, width)]
        yield NUMERIC, amounts, at, _hashes(codes, width)[at]
    slots, held = amounts, amount
    if name is not None:
        codes, slots = np.where(names, _CODES[NAME], codes), amounts | names
        held = name if amount is None else amount + name
    h = _hashes(codes, width)
    at = np.arange(n) if held is None else np.flatnonzero(width - held >= min(2, width))
    yield FULL, slots, at, h[at]
    if held is not None:
        at = np.arange(n) if every else np.flatnonzero(held > 0)
        yield WORDS, np.zeros(len(raw), bool), at, _hashes(plain, width)[at]


def _hashes(codes: np.ndarray, width: int) -> np.ndarray:
    n = max(0, len(codes) - width + 1)
    h = np.full(n, width, _U)
    for i in range(width):
        h = h * _U(0x9E3779B97F4A7C15) + codes[i : i + n]
    return mixed(h)


def _slot_values(words: list[str], slots: np.ndarray, start: int, width: int) -> list[str]:
    return [words[i].strip(_EDGES).lower() for i in range(start, start + width) if slots[i]]


_HIT = "h bigint, pos int, slots array<string>"


def hash_filter(hashes: DataFrame, count: int) -> np.ndarray:
    """Packed bits of a Bloom filter of two places over the column h; its size is bounded, whatever the count."""
    bits = next((b for b in FILTER_BITS if 1 << b >= 256 * count), FILTER_BITS[-1])
    mask = (1 << bits) - 1
    slots = hashes.select(F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask))).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 5).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("slot").bitwiseAND(31).cast("int"))).alias("on")).collect()
    out = np.zeros(1 << (bits - 5), np.uint32)
    for r in words:
        out[r["w"]] = r["on"]
    return out


def text_windows(texts: DataFrame, widths: list[int] | None, wanted: np.ndarray | None) -> DataFrame:
    """(id, th, h, pos, slots) of windows of texts (id, th, text). `widths` None: an item's own, with its number of windows of a `form` as `total` and its words as `size`. `wanted`: only windows that a hash_filter() lets pass. Each text gives a row at pos -1 too, so that the texts needn't be read again to list them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokens()
        bits = None if wanted is None else np.unpackbits(wanted.view(np.uint8), bitorder="little").view(bool)
        mask = None if bits is None else _U(len(bits) - 1)
        for batch in batches:
            for part in slices(batch, "text") if batch.num_rows else ():
                row, hs, pos, values, total, wide, kinds, sizes = [], [], [], [], [], [], [], []
                for r, text in enumerate(part.column(2).to_pylist()):
                    row.append(r)
                    hs.append(np.zeros(1, _U))
                    pos.append(-1)
                    values.append([])
                    total.append(0)
                    wide.append(0)
                    kinds.append(-1)
                    sizes.append(0)
                    words = text.split() if text else []
                    if not words:
                        continue
                    coded = canonical(words, known)
                    for width in widths or [min(WIDTH, len(words))]:
                        for form, slots, at, h in forms(*coded, width, widths is None):
                            count = len(at)
                            if bits is not None and count:
                                near = np.flatnonzero(bits[(h & mask).astype(np.int64)])
                                near = near[bits[((h[near] >> _U(32)) & mask).astype(np.int64)]]
                                at, h = at[near], h[near]
                            row += [r] * len(at)
                            hs.append(h)
                            pos += at.tolist()
                            values += [_slot_values(words, slots, i, width) for i in at.tolist()]
                            total += [count] * len(at)
                            wide += [width] * len(at)
                            kinds += [form] * len(at)
                            sizes += [len(words)] * len(at)
                rows = pa.array(row, pa.int64())
                h = np.concatenate([*hs, np.empty(0, _U)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(h), pa.array(pos, pa.int32()), pa.array(values, pa.list_(pa.string())), pa.array(total, pa.int32()), pa.array(wide, pa.int32()), pa.array(kinds, pa.int32()), pa.array(sizes, pa.int32())], names=["id", "th", "h", "pos", "slots", "total", "width", "form", "size"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, th bigint, {_HIT}, total int, width int, form int, size int")


def matches(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str, coverage: float, consistency: float) -> tuple[DataFrame, DataFrame]:
    """(id, th) of every text, and (id, th, item, covered) of texts that hold an item, a row for each occurrence."""
    items = written(benchmark.select(benchmark[item].alias("id"), F.xxhash64(item_text).alias("th"), benchmark[item_text].alias("text")), "items")
    asked = written(text_windows(items, None, None).filter("pos >= 0"), "item_windows")
    widths = [r[0] for r in asked.select("width").distinct().orderBy("width").collect()] or [WIDTH]
    count = asked.count()
    texts = docs.select(docs[key].alias("id"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("th"), docs[text].alias("text"))
    windows_ = written(text_windows(texts, widths, hash_filter(asked, count)), "windows")
    hits = windows_.filter("pos >= 0").select("id", "th", "h", "pos", "slots")
    theirs = asked.select("h", F.col("id").alias("item"), F.col("th").alias("item_th"), F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), "total", "form", "size")
    # A window of plain words has the same values on both sides, though a form with slots may give it as well.
    pairs = F.when((F.col("form") == WORDS) | (F.size("item_slots") != F.size("slots")), F.array().cast("array<struct<item_slots: string, slots: string>>")).otherwise(F.arrays_zip("item_slots", "slots"))
    met = hits.join(F.broadcast(theirs) if count <= BROADCAST_WINDOWS else theirs, "h").select("id", "th", "item", "item_th", "form", "total", "size", "item_pos", (F.col("pos") - F.col("item_pos")).alias("d"), pairs.alias("pairs"))
    # Repeated rows of a text don't count twice.
    met = written(met.distinct(), "met")
    kind = ["id", "th", "item", "item_th", "form"]
    # What the whole text doesn't have, no occurrence in it has.
    enough = met.groupBy(*kind).agg(F.count_distinct("item_pos").alias("n"), F.first("total").alias("total")).filter(F.col("n") / F.col("total") >= coverage)
    enough = written(enough.select(*(F.col(c).alias(f"_{c}") for c in kind)), "enough")
    met = met.join(enough, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in kind]).drop(*enough.columns)
    met = met.withColumn("along", F.count("*").over(Window.partitionBy(*kind, "d")))
    near = F.floor(F.col("d") / F.col("size"))
    between = F.floor((F.col("d") + F.col("size") / 2) / F.col("size"))
    as_key = lambda name, at: F.struct(F.lit(name).alias("by"), at.cast("bigint").alias("at"))
    spread = met.withColumn("occurrence", F.explode(F.array(as_key("one", F.col("d")), as_key("near", near), as_key("between", between))))
    # A window of an item counts once for an occurrence, by the alignment that has most.
    seen = spread.groupBy(*kind, "occurrence", "item_pos").agg(F.first("total").alias("total"), F.max_by("pairs", F.struct("along", -F.abs("d"), "d")).alias("pairs"))
    whole = seen.groupBy(*kind, "occurrence").agg(F.count("*").alias("n"), F.first("total").alias("total"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    # Bindings beyond one text value for an item value, or one item value for a text value, are conflicts.
    kinds = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda p: p[side])))
    consistent = F.when(F.size("pairs") == 0, F.lit(1.0)).otherwise(F.least(kinds("item_slots"), kinds("slots")) / F.size("pairs"))
    held = whole.select(*kind, "occurrence", (F.col("n") / F.col("total")).alias("covered"), (consistent >= consistency).alias("ok")).filter(F.col("covered") >= coverage)
    # Where all placeholders are met and contradict each other, numbers alone don't overrule them.
    form = F.col("form")
    most = lambda cond: F.max(F.when(cond & F.col("ok"), F.col("covered")))
    by = held.groupBy("id", "th", "item", "item_th", "occurrence").agg(most(form != NUMERIC).alias("sure"), most(form == NUMERIC).alias("numeric"), F.bool_or(form == FULL).alias("full"))
    found = by.select("id", "th", "item", F.coalesce("sure", F.when(~F.col("full"), F.col("numeric"))).alias("covered")).filter("covered is not null")
    return windows_.filter("pos < 0").select("id", "th"), found


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", coverage: float = 0.5, consistency: float = 1.0) -> DataFrame:
    """`key`, `th` (hash of the text), `contaminated`, `items` (sorted ids of the items held) and `coverage` (of the best one, 0 if none), a row for every row of `docs`."""
    rows, found = matches(docs, benchmark, key, text, item, item_text, coverage, consistency)
    by = found.groupBy(F.col("id").alias("fid"), F.col("th").alias("fth")).agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("covered").alias("covered"))
    out = rows.join(by, rows["id"].eqNullSafe(F.col("fid")) & (rows["th"] == F.col("fth")), "left")
    none = F.array().cast(f"array<{benchmark.schema[item].dataType.simpleString()}>")
    return out.select(F.col("id").alias(key), "th", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", none).alias("items"), F.coalesce("covered", F.lit(0.0)).alias("coverage"))
