"""Benchmark decontamination by template windows.

Words become a template: numbers, units and capitalised words (names, and whatever starts a sentence) turn into
typed placeholders, whose words are kept as slots. Windows of WIDTH words of the benchmark's templates meet the
documents' windows by hash join; a fixed-size bitmap of the benchmark's hashes keeps all other windows from being
shuffled. A document counts as contaminated by an item when windows that agree on their slots (each value of the
item stands for one value throughout, and the other way round) cover enough of the item. So an item is found
with other numbers, names and units as well, while texts that merely share a form are not.

Items that windows cannot tell (short ones, those of names and numbers, scripts without spaces, and those that share
a template with another item) are found word for word: the hash of the whole item's words meets that of as many words
of the documents.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from helixmart.llm.common import MULTIPLIERS, encoded, mixed, remembered, stored, table, text_batches, window_hashes, word_hashes

#: Words of a window, literal words it must have, and words of an item that must be covered (all that its windows hold,
#: if they hold fewer).
WIDTH, LITERALS, COVERED = 7, 4, 12
#: Bits of the bitmap that documents are checked against: 4 MB, whatever the benchmark's size.
BITMAP_BITS = 25

_UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers mg g kg lb lbs oz gram grams kilogram "
    "kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day "
    "days week weeks month months year years dollar dollars cent cents euro euros usd eur percent degree degrees mph kmh km/h".split())
_NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty "
    "fifty sixty seventy eighty ninety hundred thousand million billion".split())
_NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*%?([a-z/]*)\Z").match
#: Characters of scripts that are written without spaces; each counts as a word where words are compared literally.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3000-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff"
_LITERALS = re.compile(f"[{_UNSPACED}]|[^{_UNSPACED}]+").findall
_IS_UNSPACED = re.compile(f"[{_UNSPACED}]").search
#: Words of the anchor by which places of literal items are found before whole items are compared.
ANCHOR = 7
_EDGES = "\"'()[]{}<>.,;:!?…«»“”‘’`*_|"


def _template_of(token: str) -> tuple[str, str | None]:
    """Name in the template and slot value (None for a literal word); the name is empty for punctuation alone."""
    bare = token.strip(_EDGES)
    low = bare.lower()
    m = _NUMBER(low)
    if not bare:
        return "", None
    if (m and (not m[1] or m[1] in _UNITS)) or low in _NUMBER_WORDS:
        return "<number>", low
    if low in _UNITS:
        return "<unit>", low
    if bare[0].isupper():
        return "<name>", low
    return low, None


class _Codes(dict):
    """token -> 64-bit hash of its name, the last bit telling a slot; 0 for punctuation alone. Emptied when full."""

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        name, slot = _template_of(token)
        code = 0 if not name else (xxhash.xxh3_64_intdigest(encoded(name)) | 3) - (slot is None)
        if len(token) <= 64:
            self[token] = code
        return code


_CODES = _Codes()
remembered("templates", _CODES.clear)


class Template:
    """The codes of a text's words; what stood in the slots is read from the tokens only where it is asked for."""

    def __init__(self, text: str | None):
        self.tokens = (text or "").split()
        codes = np.fromiter(map(_CODES.__getitem__, self.tokens), np.uint64, len(self.tokens))
        self.at = np.flatnonzero(codes)
        self.codes = codes[self.at] if len(self.at) < len(codes) else codes
        self.slots = (self.codes & np.uint64(1)).astype(bool)

    def __len__(self) -> int:
        return len(self.codes)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each window, and which windows have enough literal words."""
        h = window_hashes(self.codes, width)
        literal = np.concatenate([[0], np.cumsum(~self.slots)])
        return h, (literal[width:] - literal[:-width]) >= LITERALS if len(h) else np.empty(0, bool)

    def names(self) -> list[str]:
        return [_template_of(self.tokens[i])[0] for i in self.at.tolist()]

    def values(self, start: int, width: int) -> list[str]:
        """Slot values of a window, empty for literal words."""
        return [_template_of(self.tokens[i])[1] or "" if s else "" for i, s in zip(
            self.at[start : start + width].tolist(), self.slots[start : start + width].tolist(), strict=True)]


_HITS = "key long, doc_id long, tie long, at int, slots array<string>"


class _Literals(dict):
    """token -> its words as they stand, lower-cased and without punctuation at the edges; emptied when full."""

    def __missing__(self, token: str) -> list[bytes]:
        if len(self) > 300_000:
            self.clear()
        found = [encoded(w) for piece in _LITERALS(token.lower()) if (w := piece.strip(_EDGES))]
        if len(token) <= 64:  # a text without spaces is one token
            self[token] = found
        return found


_LITERAL_WORDS = _Literals()
remembered("literals", _LITERAL_WORDS.clear)


def literals(text: str | None) -> list[bytes]:
    return [w for token in (text or "").split() for w in _LITERAL_WORDS[token]]


def range_hashes(h: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` values from each start on, in one step whatever the length: differences of running sums
    of values times powers of an odd number, brought to one power."""
    m = int(MULTIPLIERS[1])
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(h), m, np.uint64)) * np.uint64(pow(m, -1, 1 << 64))
        back = np.cumprod(np.full(len(h), pow(m, -1, 1 << 64), np.uint64)) * np.uint64(m)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h) * powers)])
        return mixed((sums[starts + length] - sums[starts]) * back[starts] + np.uint64(length))


def literal_items(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, anchor, length, item_id, item_words) of the items that must be met word for word.

    These are items without any window (short ones, those of names, numbers and units), with words of a script without
    spaces, and of a template that an item of smaller id has with other slots (they count as that item).
    """

    def cut(batches):
        for item, text in text_batches(batches, ["item_id", "text"], "words", "templates", "literals"):
            t, words = Template(text), literals(text)
            if not words:
                continue
            h = word_hashes(words)
            alone = not t.windows(width)[1].any() or bool(_IS_UNSPACED(text))
            # Without windows a template tells nothing; such items are one only if their words are.
            form = b" ".join([b"=", *words]).decode("utf-8", "replace") if alone else " ".join(t.names())
            yield pa.RecordBatch.from_arrays(
                [pa.array(range_hashes(h, np.zeros(1, np.int64), len(h)).view(np.int64)),
                 pa.array(window_hashes(h[:ANCHOR], min(ANCHOR, len(h))).view(np.int64)), pa.array([len(h)], pa.int32()),
                 pa.array([item], pa.int64()), pa.array([max(len(t), 1)], pa.int32()), pa.array([form]), pa.array([alone])],
                ["key", "anchor", "length", "item_id", "item_words", "form", "alone"])

    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    rows = items.mapInArrow(cut, "key long, anchor long, length int, item_id long, item_words int, form string, alone boolean")
    # One row per wording of a template; its first wording has windows, unless the template stands alone.
    wordings = rows.groupBy("form", "alone", "key", "length").agg(F.min("item_id").alias("own"), F.first("anchor").alias("anchor"),
                                                                  F.first("item_words").alias("item_words"))
    first = wordings.groupBy("form").agg(F.min("own").alias("item_id"))
    return stored(wordings.join(first, "form").where("alone OR own > item_id").select("key", "anchor", "length", "item_id", "item_words"))


def verbatim(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, tie, item_id, item_words): the documents (doc_id, tie, text) that hold one of ``literal_items``."""
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast((_bitmap(items, "anchor"), _bitmap(items, "key")))

    def cut(batches):
        anchors, keys = shared.value
        for doc_id, tie, text in text_batches(batches, ["doc_id", "tie", "text"], "words", "templates", "literals"):
            h = word_hashes(literals(text))
            at = {n: np.flatnonzero(_marked(anchors, window_hashes(h, n))) for n in {min(ANCHOR, n) for n in lengths}}
            for n in lengths:
                starts = at[min(ANCHOR, n)]
                starts = starts[starts + n <= len(h)]
                if len(starts):
                    found = np.unique(range_hashes(h, starts, n))
                    found = found[_marked(keys, found)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found.view(np.int64)), pa.array([n] * len(found), pa.int32()), pa.array([doc_id] * len(found), pa.int64()),
                         pa.array([tie] * len(found), pa.int64())], ["key", "length", "doc_id", "tie"])

    met = docs.mapInArrow(cut, "key long, length int, doc_id long, tie long").join(items.drop("anchor"), ["key", "length"])
    return met.select("doc_id", "tie", "item_id", "item_words")


def _bitmap(items: DataFrame, key: str) -> np.ndarray:
    """Fixed-size bitmap of the upper bits of ``key``; filled from at most 2 ** BITMAP_BITS places."""
    marks = items.select(F.shiftrightunsigned(F.col(key), 64 - BITMAP_BITS).alias("p")).distinct()
    bitmap = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for part in marks.toLocalIterator():
        bitmap[part[0] >> 3] |= 1 << (part[0] & 7)
    return bitmap


def _marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h >> np.uint64(64 - BITMAP_BITS)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, item_id, item_words, reach, item_at, item_slots); reach is the number of the item's words that its windows
    hold. Items of one template count as the one of smallest id."""

    def cut(batches):
        for item, text in text_batches(batches, ["item_id", "text"], "words", "templates", "literals"):
            t = Template(text)
            h, good = t.windows(width)
            at = np.flatnonzero(good)
            if len(at):
                form = " ".join(t.names())
                reach = len(np.unique(at[:, None] + np.arange(width)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[at].view(np.int64)), pa.array([item] * len(at), pa.int64()), pa.array([len(t)] * len(at), pa.int32()),
                     pa.array([reach] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array([t.values(i, width) for i in at.tolist()], pa.list_(pa.string())),
                     pa.array([form] * len(at))], ["key", "item_id", "item_words", "reach", "item_at", "item_slots", "form"])

    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    cuts = stored(items.mapInArrow(cut, "key long, item_id long, item_words int, reach int, item_at int, item_slots array<string>, form string"))
    first = cuts.groupBy("form").agg(F.min("item_id").alias("item_id"))
    return stored(cuts.join(first, ["form", "item_id"], "left_semi").drop("form").dropDuplicates(["item_id", "item_at"]))


def _places(hits: list[dict], width: int) -> list[list[dict]]:
    """Where a document may hold the item: every diagonal (equal distance to the item) by itself, and stretches of
    neighbouring diagonals, for copies with some words more or less."""
    lines: dict[int, list[dict]] = {}
    for x in hits:
        lines.setdefault(x["at"] - x["item_at"], []).append(x)
    near, last = [], None
    for diagonal in sorted(lines):
        if last is None or diagonal - last > 2:
            near.append([])
        near[-1].append(lines[diagonal])
        last = diagonal
    places = list(lines.values())
    for band in near:
        if len(band) > 1:
            joined = sorted((x for line in band for x in line), key=lambda x: (x["at"], x["item_at"]))
            cuts = [i for i in range(1, len(joined)) if joined[i]["at"] - joined[i - 1]["at"] > 3 * width]
            places += [joined[i:j] for i, j in zip([0, *cuts], [*cuts, len(joined)], strict=True)]
    return places


def _agreeing(hits: list[dict], width: int) -> tuple[int, int, bool]:
    """Of one document's hits with one item: words of the item covered in the best place, windows, and whether all
    slots are the item's own."""
    best = (0, 0, False)
    for place in _places(hits, width):
        pairs = Counter(p for x in place for p in set(zip(x["item_slots"], x["slots"], strict=True)) if p[0])
        ours, theirs = {}, {}
        for (a, b), _ in pairs.most_common():
            if a not in ours and b not in theirs:
                ours[a], theirs[b] = b, a
        good = [x for x in place if all(not a or ours.get(a) == b for a, b in zip(x["item_slots"], x["slots"], strict=True))]
        words = {x["item_at"] + i for x in good for i in range(width)}
        best = max(best, (len(words), len(good), all(x["item_slots"] == x["slots"] for x in good)))
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, covered: int = COVERED) -> DataFrame:
    """(doc_id, tie, item_id, covered_words, item_words, n_windows, same_slots): one row per document (doc_id, text)
    and benchmark item (item_id, text) found in it; tie is a hash of the text.

    Null and empty texts match nothing; items that only a verbatim copy can tell
    (``literal_items``) have n_windows 0 unless windows found them too. Items with one template count as the one with
    the smallest id; null item ids are ignored. Repeated rows of
    documents give one row. Empty tables give no rows.
    """
    spark = docs.sparkSession
    items = item_windows(benchmark, width)
    shared = spark.sparkContext.broadcast(_bitmap(items, "key"))

    def cut(batches):
        bits, out = shared.value, []
        for doc_id, tie, text in text_batches(batches, ["doc_id", "tie", "text"], "words", "templates", "literals"):
            t = Template(text)
            h, good = t.windows(width)
            some = np.flatnonzero(good)
            for i in some[_marked(bits, h[some])].tolist():
                out.append((int(h[i].view(np.int64)), doc_id, tie, i, t.values(i, width)))
            if len(out) > 5000:
                yield _hit_batch(out)
                out = []
        if out:
            yield _hit_batch(out)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    met = docs.mapInArrow(cut, _HITS).join(items, "key")

    def judge(t):
        rows = t.select(["at", "item_at", "slots", "item_slots"]).to_pylist()
        words, n, same = _agreeing(list({(r["at"], r["item_at"]): r for r in rows}.values()), width)
        size = t["item_words"][0].as_py()
        keep = words >= min(covered, t["reach"][0].as_py())
        return pa.table({"doc_id": t["doc_id"][:1], "tie": t["tie"][:1], "item_id": t["item_id"][:1], "covered_words": pa.array([words], pa.int32()),
                         "item_words": pa.array([size], pa.int32()), "n_windows": pa.array([n], pa.int32()),
                         "same_slots": [same]}).slice(0, int(keep))

    found = met.groupBy("doc_id", "tie", "item_id").applyInArrow(
        judge, "doc_id long, tie long, item_id long, covered_words int, item_words int, n_windows int, same_slots boolean")
    wordings = literal_items(benchmark, width)
    if wordings.isEmpty():
        return found
    exact = verbatim(docs, wordings).select("doc_id", "tie", "item_id", F.col("item_words").alias("covered_words"), "item_words",
                                            F.lit(0).alias("n_windows"), F.lit(True).alias("same_slots"))
    return found.unionByName(exact).groupBy("doc_id", "tie", "item_id").agg(*[
        F.max(c).alias(c) for c in ("covered_words", "item_words", "n_windows", "same_slots")])


def _hit_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "doc_id", "tie", "at", "slots"])


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return contaminated(docs, table(spark, folder, "benchmark").select("item_id", "text")).drop("tie")
