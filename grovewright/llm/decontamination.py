"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The test items are a stated query set; they are taken in blocks of at most BLOCK_WORDS
words, each of which goes to all executors, so what is broadcast has a proven bound. For
every block the corpus is read twice: to count in how many documents each word n-gram of
the items occurs, and to look for seeds in the texts that have any (by a filter of fixed
size over hashes of texts). An item's rare seeds are its RARE rarest n-grams and
all others not much more frequent than these; they seed wherever they stand. Its other
n-grams seed too, but only in documents that hold SHARE / 2 of the item's words: in any
other no alignment can be reported, so nothing is lost while phrases common in the corpus
cost one count a document. Around each seed hit the passage is aligned with the item by
words (match +2, mismatch and gap -1); the score is the share of the item's words that
match in the best local alignment, 0 below SHARE / 2. matches() adds the columns __items
and __score, which docs must not have. A passage that keeps no N words of
an item in a row (one in N changed throughout) has no seed and scores 0.

Null, empty and short texts align with nothing (score 0). Items with fewer words than an
n-gram seed with all they have; empty and null items are left out. Repeated rows get a
row each. Extra columns are ignored. An empty benchmark gives score 0 everywhere.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE, Bloom, Shared, WordHash, discard, free, ngrams, raw, stored, tidied

N = 3
RARE = 12
BLOCK_WORDS = 2_000_000
SHARE = 0.6
SMALL = 1 << 16  # words by words that are compared at once rather than sorted
EDGE = bytes(sorted(set(range(128)) - set(b"abcdefghijklmnopqrstuvwxyz0123456789")))
SPLIT = re.compile(rb"[ \t\n\x0b\x0c\r]+")


class PlainHash(WordHash):
    """Hash of a word in lower case without the signs at its ends."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = xxhash.xxh64_intdigest(word.lower().strip(EDGE)) - (1 << 63)
        self[word] = h
        return h


def align(item: np.ndarray, text: np.ndarray, match: int = 2, cost: int = 1) -> tuple[int, int, int]:
    """Smith-Waterman with linear gaps: (matching words on the best path, its first and last + 1 word in text).

    A row is one vector operation: gaps along the row come from a running maximum.
    """
    n, m = len(item), len(text)
    along = (cost * np.arange(m + 1)).astype(np.int32)
    h = np.zeros((n + 1, m + 1), np.int32)
    same = item[:, None] == text[None, :]
    gain = np.where(same, np.int32(match), np.int32(-cost))
    for i in range(n):
        row = h[i + 1]
        np.maximum(h[i, :-1] + gain[i], h[i, 1:] - np.int32(cost), out=row[1:])
        np.maximum(row, 0, out=row)
        row += along
        np.maximum.accumulate(row, out=row)
        row -= along
    i, j = divmod(int(h.argmax()), m + 1)
    matched, end = 0, j
    while i and j and h[i, j] > 0:
        if same[i - 1, j - 1] and h[i, j] == h[i - 1, j - 1] + match:
            matched, i, j = matched + 1, i - 1, j - 1
        elif not same[i - 1, j - 1] and h[i, j] == h[i - 1, j - 1] - cost:
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] - cost:
            i -= 1
        else:
            j -= 1
    return matched, j, end


class Sieve:
    """Sorted 64-bit hashes with a bitmap of their leading bits, which rules out most others by one look each."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.shift = np.uint64(64 - min(26, max(16, (8 * max(1, len(table))).bit_length())))
        self.map = np.zeros(1 << (64 - int(self.shift)), bool)
        self.map[table >> self.shift] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h, places in the table) of the hashes that the table holds."""
        at = np.flatnonzero(self.map[h >> self.shift])
        if not len(at):
            return at, at
        place = np.minimum(np.searchsorted(self.table, h[at]), len(self.table) - 1)
        same = self.table[place] == h[at]
        return at[same], place[same]


class Items:
    """A block of items: their word hashes, and n-gram hash -> (item, position)."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        hashed = PlainHash()
        self.ids = [i for i, _ in rows]
        self.words = [hashed.of(SPLIT.sub(b" ", t).split()) for _, t in rows]
        self.grams = [ngrams(w, min(N, len(w))) for w in self.words]
        self.every = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.grams]))
        self.sieve = Sieve(self.every)
        self.short = sorted({len(w) for w in self.words if len(w) < N})
        self.vocabulary, self.flat = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.words]), return_inverse=True)
        self.words_sieve = Sieve(self.vocabulary)
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.offset = np.cumsum(self.size) - self.size  # of an item's words in flat

    def choose(self, frequency: np.ndarray) -> None:
        """Set up the seeds, given the number of documents for each of self.every: each n-gram with its items, positions, and whether it is rare in the item."""
        grams, item, at, rare = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for k, g in enumerate(self.grams):
            f = frequency[np.searchsorted(self.every, g)]
            seen = np.sort(f[f > 0])
            limit = 4 * max(1, seen[min(RARE, len(seen)) - 1]) if len(seen) else 0
            grams.append(g)
            item.append(np.full(len(g), k))
            at.append(np.arange(len(g)))
            rare.append(f <= limit)
        grams = np.concatenate(grams)
        order = np.argsort(grams, kind="stable")
        self.item, self.at, self.rare = (np.concatenate(x)[order] for x in (item, at, rare))
        _, self.first, self.times = np.unique(grams[order], return_index=True, return_counts=True)  # in the order of self.every

    def enough(self, h: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Which of the items have so many of their words in the text that an alignment can reach SHARE / 2."""
        there = np.zeros(len(self.vocabulary), bool)
        there[self.words_sieve.hits(h)[1]] = True
        size = self.size[items]
        begins = np.cumsum(size) - size
        words = self.flat[np.arange(size.sum()) + np.repeat(self.offset[items] - begins, size)]
        return np.add.reduceat(there[words].astype(np.int64), begins) / size >= SHARE / 2

    def found(self, h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(positions, places in self.every) of a text's n-grams that items have."""
        out = []
        for n in [N, *self.short]:
            hit, place = self.sieve.hits(ngrams(h, n))
            if len(hit):
                out.append((hit, place))
        return out

    def best(self, h: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, share of its words matched, first and last + 1 word) for every item with a seed in the text."""
        windows: dict[int, list[int]] = defaultdict(list)
        for hits, seed in self.found(h):
            times = self.times[seed]
            each = np.arange(times.sum()) + np.repeat(self.first[seed] - (np.cumsum(times) - times), times)
            item, start, rare = self.item[each], np.repeat(hits, times) - self.at[each], self.rare[each]
            if not rare.all():
                tested, of = np.unique(item[~rare], return_inverse=True)
                rare[~rare] = self.enough(h, tested)[of]
            for k, s in zip(item[rare].tolist(), start[rare].tolist()):
                windows[k].append(s)
        out = []
        for k, starts in windows.items():
            item = self.words[k]
            slack = len(item) // 2 + 2
            starts.sort()
            tops, lo = (0.0, 0, 0), 0
            while lo < len(starts):  # hits whose windows overlap are aligned at once, up to a few lengths
                hi = lo
                while hi + 1 < len(starts) and starts[hi + 1] - starts[hi] <= slack and starts[hi + 1] - starts[lo] <= 4 * len(item) + 8:
                    hi += 1
                a, b = max(0, starts[lo] - slack), min(len(h), starts[hi] + len(item) + slack)
                near = h[a:b]
                held = (item[:, None] == near).any(axis=1) if len(item) * len(near) <= SMALL else np.isin(item, near)
                if held.mean() >= max(tops[0], SHARE / 2):  # else no alignment can be better
                    matched, x, y = align(item, near)
                    tops = max(tops, (matched / len(item), a + x, a + y))
                lo = hi + 1
            if tops[0] > 0:
                out.append((k, *tops))
        return out


def blocks(benchmark: DataFrame, id_column: str, text_column: str):
    held, size = [], 0
    for r in benchmark.select(id_column, text_column).where(F.col(text_column).isNotNull()).toLocalIterator():
        t = r[1].encode()
        n = len(t.split())
        if not n:
            continue
        if held and size + n > BLOCK_WORDS:
            yield Items(held)
            held, size = [], 0
        held.append((r[0], t))
        size += n
    if held:
        yield Items(held)


def frequencies(docs: DataFrame, items: Items) -> tuple[np.ndarray, Bloom]:
    """In how many documents (key: hash of the text, text) each n-gram of the items occurs, and a filter of the texts with any; each task counts before anything is moved."""
    held = Shared(docs.sparkSession, items)

    def run(batches):
        hashed, items = PlainHash(), held.value
        total = np.zeros(len(items.every), np.int64)
        for batch in batches:
            keys = []
            for key, t in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                found = items.found(hashed.of((t or b"").split()))
                for _, place in found:
                    total[np.unique(place)] += 1
                if found:
                    keys.append(key)
            yield pa.RecordBatch.from_pydict({"at": pa.array(keys, pa.int64()), "n": pa.array([0] * len(keys), pa.int64())})
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    rows = stored(docs.mapInArrow(tidied(run), "at long, n long"))
    out = np.zeros(len(items.every), np.int64)
    for r in rows.where("n > 0").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most the n-grams of a block
        out[r["at"]] = r["n"]
    bloom = Bloom.build(rows.where("n = 0").select("at").distinct(), "at")
    discard(rows)
    return out, bloom


def matches(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """docs with __items (array of item, score, first and last + 1 word) and __score; by blocks of items, without a shuffle."""
    spark = docs.sparkSession
    columns, at = docs.columns, docs.columns.index(text_column)
    item_kind = benchmark.schema[item_column].dataType.simpleString()
    found_type = f"array<struct<item_id:{item_kind},score:double,first:bigint,last:bigint>>"
    item_type = {"bigint": pa.int64(), "int": pa.int32()}.get(item_kind, pa.string())
    found_arrow = pa.list_(pa.struct([("item_id", item_type), ("score", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = docs.withColumn("__items", F.array().cast(found_type))
    for items in blocks(benchmark, item_column, "text"):
        frequency, bloom = frequencies(docs.select(F.xxhash64(text_column).alias("key"), F.col(text_column).alias("text")), items)
        items.choose(frequency)
        held, bits, bitmap = Shared(spark, items), bloom.bits, spark.sparkContext.broadcast(bloom.data)

        def run(batches, held=held, bits=bits, bitmap=bitmap):
            hashed, items, bloom = PlainHash(), held.value, Bloom(bits, bitmap.value)
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    part = batch.slice(lo, 512)
                    may = bloom.has(part.column(len(columns) + 1).to_numpy()).tolist()  # else no n-gram of an item is in the text
                    found = []
                    for m, t, before in zip(may, raw(part.column(at)), part.column(len(columns)).to_pylist()):
                        if not m:
                            found.append(before)
                            continue
                        best = ((items.ids[k], s, x, y) for k, s, x, y in items.best(hashed.of((t or b"").split())) if s >= SHARE / 2)
                        found.append(before + [{"item_id": i, "score": s, "first": x, "last": y} for i, s, x, y in sorted(best, key=lambda b: (-b[1], b[0]))])
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], pa.array(found, found_arrow)], names=part.schema.names[:-1])

        out = out.withColumn(free(out, "hash"), F.xxhash64(text_column)).mapInArrow(tidied(run), f"{fields}, `__items` {found_type}")
    return out.withColumn("__score", F.coalesce(F.array_max(F.transform("__items", lambda x: x["score"])), F.lit(0.0)))


def flag(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """Per row: doc_id, contaminated, score, item_ids (those at or above share)."""
    found = matches(docs.select("doc_id", "text"), benchmark)
    items = F.transform(F.filter("__items", lambda x: x["score"] >= share), lambda x: x["item_id"])
    return found.select("doc_id", (F.col("__score") >= share).alias("contaminated"), F.col("__score").alias("score"), items.alias("item_ids"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """docs without the contaminated rows."""
    return matches(docs, benchmark).where(F.col("__score") < share).drop("__items", "__score")
