"""Benchmark decontamination by template canonicalisation.

Texts become templates: words in lower case without outer punctuation, numbers (with a unit glued to them or not)
as <num>, units as <unit>, capitalised words inside a sentence as <name>; what was replaced stays as the
placeholder's slot. A run of names is one <name>, a number and the unit after it one <num>. Capitalised words that begin a
sentence may be names or not, so items and documents have two readings, and of their matches the best counts. Five-token
windows of templates are hash-joined with those of the benchmark items, so a question with other numbers, names or
units still meets its item. A document leaks an item if, within a stretch of twice the item's length, it has at least `share`
of the item's windows, and the slots agree: of the slot pairs in the matched windows at least `agree` follow one
mapping from item values to document values and back, as they do when a question is re-parameterised (all values kept is
the plain copy). Windows of fewer than three literal words count only where an item has no others. An item of fewer than
five tokens is one window of its own length: documents of just that length match it like any other, longer ones where
they have it with the same slots.

1. Items become a table of windows. Their hashes set bits of a filter (256 bits a window, at most 2 ** MOST_BITS: beyond
   that more windows pass, and the join drops them), by which documents pass on only windows that an item may have; it is
   all that is broadcast.
2. The windows that pass are joined with the items' rarest ones: an item with n windows, of which it may miss m, is met by one of
   its m + 1 rarest if it is leaked at all, so windows that very many items share make no candidates.
3. Candidates (document, item) are joined with all their windows and tested one by one, each in a group of its own.

One row per document and item found: doc_id, item_id, containment, slot_agreement, contaminated (true). Null and empty
texts match nothing, an item without words or with a null text is skipped, null ids are reported as null, repeated
rows are each reported, repeated items (same id and text) once; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from itertools import chain
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, shingles

# fixed values: units that a number may carry
UNITS = "mm cm dm m km in ft yd mi mg g kg t oz lb ml cl l s sec min h hr hrs ms day days week weeks month months year years % ° °c °f usd eur gbp dollars euros cents hz khz mhz w kw v a j kj kb mb gb tb mph kmh".split()

LITERAL, NUM, UNIT, NAME = 0, 1, 2, 3
MOST_BITS = 28  # two to this power: 32 MB
_OUTER = b" \t!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_NUMBER = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*([^\W\d_]{1,4}|%|°)?$")
_MARKS = {k: np.uint64(xxhash.xxh3_64_intdigest(b"<%d>" % k)) for k in (NUM, UNIT, NAME)}
_units = frozenset(UNITS)
_unit_bytes = frozenset(u.encode() for u in UNITS)


# what a word is, in one byte: its kind plus one (0: no core) and these
CAP, ENDS, CUT, BARE = 8, 16, 32, 64


class _Words(dict):
    """Places of words in a lexicon's tables; a word that isn't there is added to them."""

    def __init__(self, add):
        self.add = add

    def __missing__(self, word: bytes) -> int:
        self[word] = n = self.add(word)
        return n


class Lexicon:
    """Words as rows of small tables: template hash, and kind, whether it may be a name, whether it ends a sentence, whether it ends
    a clause, whether it is a number without unit."""

    _own: Lexicon | None = None

    def __init__(self):
        self.clear()

    @classmethod
    def shared(cls) -> Lexicon:
        """One for each Python worker."""
        cls._own = cls._own or cls()
        return cls._own

    def clear(self) -> None:
        self.index = _Words(self._add)
        self.hash, self.flags = array("Q"), array("B")

    def _add(self, word: bytes) -> int:
        core, last, flags = word.strip(_OUTER), word[-1:], 0
        if core.islower() and core.isalpha():  # a to z only
            kind, low = UNIT if core in _unit_bytes else LITERAL, core
        else:
            text = core.decode("utf-8", "replace")
            low = text.lower()
            kind = NUM if core[:1].isdigit() and _NUMBER.match(text) else UNIT if low in _units else LITERAL
            if kind == LITERAL and text[:1].isupper() and (len(text) == 1 or not text.isupper()):
                flags |= CAP
            if kind == NUM and core[-1:].isdigit():
                flags |= BARE
            low = low.encode()
        if len(core) < len(word):
            if word.rstrip(b"\"')]*#$%&")[-1:] in (b".", b"!", b"?", b":"):
                flags |= ENDS
            if last in b",;:.!?)":
                flags |= CUT
        self.hash.append(0 if not core else int(_MARKS[kind]) if kind else xxhash.xxh3_64_intdigest(low))
        self.flags.append(flags | kind + 1 if core else flags)
        return len(self.hash) - 1

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, Values, np.ndarray]]]:
        """Which texts have two readings, and of each reading (hashes, kinds, values) of the tokens of all texts in turn and how many
        tokens each text has: with the words that begin a sentence as they are, and with the capitalised ones of them as
        names; words without a core are left out."""
        if len(self.index) > 400_000:
            self.clear()
        split = [(t or "").encode("utf-8", "replace").split() for t in texts]
        found = list(chain.from_iterable(split))
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in split])
        at = np.fromiter(map(self.index.__getitem__, found), np.int64, len(found))
        # views of growing arrays, which must be gone before the next word is added
        hashes, flags = np.frombuffer(self.hash, np.uint64)[at], np.frombuffer(self.flags, np.uint8)[at]
        begins = np.ones(len(found), bool)
        begins[1:] = owner[1:] != owner[:-1]
        cap = flags & CAP != 0
        inside = cap & ~begins
        inside[1:] &= flags[:-1] & ENDS == 0
        kept = np.flatnonzero(flags & 7)
        if len(kept) < len(found):
            hashes, flags, cap, inside, owner = (x[kept] for x in (hashes, flags, cap, inside, owner))
            begins = np.ones(len(kept), bool)
            begins[1:] = owner[1:] != owner[:-1]
        two = np.zeros(len(texts), bool)
        two[owner[cap != inside]] = True
        kinds = (flags & 7).view(np.int8) - np.int8(1)
        after = (kinds[1:] == UNIT) & (flags[:-1] & BARE != 0)
        tied = ~begins[1:] & (flags[:-1] & CUT == 0)
        out = []
        for name in (inside, cap):
            first = begins.copy()
            first[1:] = ~((name[1:] & name[:-1] | after) & tied)
            starts = np.flatnonzero(first)
            is_name = name[starts]
            h, k = np.where(is_name, _MARKS[NAME], hashes[starts]), np.where(is_name, np.int8(NAME), kinds[starts])
            out.append((h, k, Values(found, kept, starts), np.bincount(owner[starts], minlength=len(texts))))
        return two, out

    def readings(self, text: str | None) -> list[tuple[np.ndarray, np.ndarray, Values]]:
        """(hashes, kinds, values) of each reading of one text."""
        two, both = self.read([text])
        return [x[:3] for x in (both if two[0] else both[:1])]


class Values:
    """What stands for each token: one word, or the words of a run. kept: places of the words with a core."""

    def __init__(self, words: list[bytes], kept: np.ndarray, starts: np.ndarray):
        self.words, self.kept, self.starts = words, kept, starts

    def __getitem__(self, i: int) -> bytes:
        end = self.starts[i + 1] if i + 1 < len(self.starts) else len(self.kept)
        return b" ".join([self.words[k] for k in self.kept[self.starts[i] : end]]).strip(_OUTER).lower()


def _keys(hashes: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all windows; those of another size are other fingerprints."""
    return shingles.windows(hashes, size) ^ np.uint64(min(size, len(hashes)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def _keys_of_rows(rows: np.ndarray) -> np.ndarray:
    """The same of windows that are the rows of a matrix."""
    return shingles.windows_of_rows(rows) ^ np.uint64(rows.shape[1] * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def item_windows(text: str | None, size: int) -> list[tuple[int, list[tuple[int, int, list[int], list[bytes]]]]]:
    """(length in tokens, [(key, position, kinds, values) of each window that counts]) of an item's readings."""
    out = []
    for r, (hashes, kinds, values) in enumerate(Lexicon.shared().readings(text)):
        n = len(hashes)
        if not n or r and n < size:
            continue
        literal = np.convolve(kinds == LITERAL, np.ones(min(size, n), int), "valid")
        use = literal >= 3
        if not use.any():
            if r:
                continue
            use[:] = True
        keys, k = _keys(hashes, size).view(np.int64), min(size, n)
        out.append((n, [(int(keys[p]), p, kinds[p : p + k].tolist(), [values[i] for i in range(p, p + k)]) for p in np.flatnonzero(use).tolist()]))
    return out


def match(n: int, count: int, pairs: list[tuple], share: float, size: int) -> tuple[float, float]:
    """(containment, slot agreement) of an item reading in a document reading.

    n: the item's tokens, count: its windows. pairs: (p, q, kinds, item values, document values, whole) of each pair of equal windows.
    """
    if n < size:
        p = max(pairs, key=lambda x: (x[5], x[3] == x[4]))
        if p[5]:  # the document is no longer than the item
            return 1.0, _agreement([p])
        literal = all(k == LITERAL or a == b for k, a, b in zip(p[2], p[3], p[4], strict=True))
        return (1.0, 1.0) if literal else (0.0, 0.0)
    pairs = sorted(pairs, key=lambda x: x[:2])
    reach, best, lo, inside, span = 2 * n, 0, 0, Counter(), (0, 0)
    for hi, (p, q, *_) in enumerate(pairs):
        inside[q] += 1
        while pairs[lo][0] < p - reach:
            inside[pairs[lo][1]] -= 1
            if not inside[pairs[lo][1]]:
                del inside[pairs[lo][1]]
            lo += 1
        if len(inside) > best:
            best, span = len(inside), (lo, hi + 1)
    contained = best / count
    return (contained, _agreement(pairs[span[0] : span[1]])) if contained >= share else (contained, 0.0)


def _agreement(pairs: list[tuple]) -> float:
    """Share of slot pairs that follow one mapping between item values and document values, both ways."""
    slots = set()
    for _, q, kinds, mine, theirs, _ in pairs:
        slots |= {(k, q + o, a, b) for o, (k, a, b) in enumerate(zip(kinds, mine, theirs, strict=True)) if k != LITERAL}
    if not slots:
        return 1.0
    there = Counter((kind, a, b) for kind, _, a, b in slots)
    by_a, by_b = defaultdict(Counter), defaultdict(Counter)
    for (kind, a, b), n in there.items():
        by_a[(kind, a)][b] += n
        by_b[(kind, b)][a] += n
    good = sum(n for (kind, a, b), n in there.items() if by_a[(kind, a)].most_common(1)[0][0] == b and by_b[(kind, b)].most_common(1)[0][0] == a)
    return good / len(slots)


_ITEM = "item long, reading int, n int, count int, spare int, key long, q int, kinds array<byte>, mine array<binary>"
_HIT = "doc long, doc_id long, way int, key long, p int, theirs array<binary>, whole boolean"


def _arrays(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _item_table(items: DataFrame, size: int, share: float) -> DataFrame:
    """A row per window that counts of each item reading, items numbered."""
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int8()), pa.list_(pa.binary())]
    names = [x.split()[0] for x in _ITEM.split(", ")]

    def explode(batches):
        common.take_turn("templates", Lexicon.shared().clear)
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for r, (n, found) in enumerate(item_windows(text, size)):
                    # share * count windows at least must be there, rounded as the test itself does
                    least = next(k for k in range(max(1, ceil(share * len(found)) - 1), len(found) + 1) if k / len(found) >= share) if found else 0
                    rows += [(item, r, n, len(found), len(found) - least, *w) for w in found]
                    if len(rows) > 20_000:
                        yield _arrays(rows, kinds, names)
                        rows = []
            yield _arrays(rows, kinds, names)

    return items.select("item", "text").mapInArrow(explode, _ITEM)


def _filter(keys: DataFrame, bits: int) -> np.ndarray:
    """2 ** bits bits, of which each key sets the two that its first and its next `bits` bits number; gathered as at most 2 ** (bits - 6) rows."""
    first, second = (F.expr(f"shiftrightunsigned(key, {64 - k * bits}) & {(1 << bits) - 1}L") for k in (1, 2))
    slots = keys.select(F.explode(F.array(first, second)).alias("slot"))
    words = slots.select(F.expr("shiftrightunsigned(slot, 6)").alias("word"), F.expr("shiftleft(1L, cast(slot & 63L as int))").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, np.uint64)
    if got.num_rows:
        out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _passing(table: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Places of the keys whose two bits are set."""
    at = np.arange(len(keys))
    for k in (1, 2):
        slot = keys[at] >> np.uint64(64 - k * bits) & np.uint64((1 << bits) - 1)
        at = at[(table[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)]
    return at


def _groups(texts: list[str | None], most: int = 100_000) -> list[tuple[int, int]]:
    """Runs of neighbouring texts of at most so many characters together, or of one text."""
    out, lo, n = [], 0, 0
    for i, t in enumerate(texts):
        m = len(t or "")
        if n + m > most and i > lo:
            out.append((lo, i))
            lo, n = i, 0
        n += m
    return [*out, (lo, len(texts))] if texts else out


def _found(texts: list[str | None], table: np.ndarray, bits: int, size: int, lengths: list[int]):
    """(reading, text, position, key, values, whether the text has no more tokens) of each window that passes the filter: windows of
    `size` tokens, of the lengths of shorter items, and short texts as a whole."""
    two, both = Lexicon.shared().read(texts)
    for way, (hashes, _, values, counts) in enumerate(both):
        owner, begin = np.repeat(np.arange(len(texts)), counts), np.cumsum(counts) - counts
        for k in range(1, size + 1):
            if k == size or k in lengths:
                if len(hashes) < k:
                    continue
                keys = _keys(hashes, k)
                at = _passing(table, keys, bits)
                at = at[owner[at] == owner[at + k - 1]]  # windows end with their text
                passed = keys[at]
            else:
                at = begin[counts == k]
                passed = _keys_of_rows(hashes[at[:, None] + np.arange(k)])
                good = _passing(table, passed, bits)
                at, passed = at[good], passed[good]
            for p, t, key in zip(at.tolist(), owner[at].tolist(), passed.view(np.int64).tolist(), strict=True):
                if two[t] or not way:
                    yield way, t, p - int(begin[t]), key, [values[i] for i in range(p, p + k)], bool(counts[t] <= k)


def _hits(docs: DataFrame, sent, bits: int, size: int, lengths: list[int]) -> DataFrame:
    """Windows of documents that pass the filter, with the values of all their tokens."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.bool_()]
    names = [x.split()[0] for x in _HIT.split(", ")]

    def probe(batches):
        common.take_turn("templates", Lexicon.shared().clear)
        table = sent.value
        for b in batches:
            docs, ids, texts = (b.column(k).to_pylist() for k in range(3))
            rows = []
            for lo, hi in _groups(texts):
                for way, t, p, key, theirs, whole in _found(texts[lo:hi], table, bits, size, lengths):
                    rows.append((docs[lo + t], ids[lo + t], way, key, p, theirs, whole))
                    if len(rows) > 5_000:
                        yield _arrays(rows, kinds, names)
                        rows = []
            yield _arrays(rows, kinds, names)

    return docs.mapInArrow(probe, _HIT)


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 5, share: float = 0.8, agree: float = 0.8, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, item_id, containment, slot_agreement, contaminated: a row per document row and item that it leaks."""
    spark = docs.sparkSession
    common.tune(spark)
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    items = common.staged(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    windows = common.staged(_item_table(items, window, share), "windows")
    lengths = [r[0] for r in windows.where(F.col("n") < window).select("n").distinct().collect()]  # fewer than `window` rows
    bits = min(most_bits, windows.count().bit_length() + 8)
    sent = spark.sparkContext.broadcast(_filter(windows.select("key"), bits))
    src = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hits = common.staged(_hits(src, sent, bits, window, lengths), "hits")
    sent.unpersist()

    # an item's rarest windows, one more than it may miss
    known = windows.groupBy("key").agg(F.count("*").alias("holders"))
    first = windows.select("item", "reading", "spare", "key").distinct().join(known, "key")
    first = first.withColumn("nth", F.row_number().over(Window.partitionBy("item", "reading").orderBy("holders", "key"))).where("nth <= spare + 1")
    first = common.staged(first.select("key", "item", "reading").distinct(), "rarest")
    found = common.staged(hits.select("doc", "way", "key").distinct().join(first, "key").select("doc", "way", "item", "reading").distinct(), "candidates")
    both = found.join(hits, ["doc", "way"]).join(windows, ["item", "reading", "key"])

    # a group is what one document has of one item
    pair = F.struct("p", "q", "kinds", "mine", "theirs", "whole")
    grouped = both.groupBy("doc", "way", "item", "reading").agg(*[F.first(c).alias(c) for c in ("doc_id", "n", "count")], F.collect_list(pair).alias("pairs"))

    def test(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                contained, agreed = match(r["n"], r["count"], [tuple(x.values()) for x in r["pairs"]], share, window)
                if contained >= share and agreed >= agree:
                    rows.append((r["doc"], r["doc_id"], r["item"], contained, agreed))
            yield _arrays(rows, [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()], ["doc", "doc_id", "item", "containment", "slot_agreement"])

    hit = grouped.mapInArrow(test, "doc long, doc_id long, item long, containment double, slot_agreement double")
    best = hit.groupBy("doc", "item").agg(F.max(F.struct("containment", "slot_agreement")).alias("m"), F.max("doc_id").alias("doc_id"))
    return best.join(items.select("item", "item_id"), "item").select("doc_id", "item_id", "m.containment", "m.slot_agreement", F.lit(True).alias("contaminated"))


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark"))
