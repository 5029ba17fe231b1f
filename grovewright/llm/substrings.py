"""Substring dedup: suffix automata of reference shards find and cut repeated spans.

A word goes if a window of `least` words covers it whose sequence also starts earlier.
Streaming every document past the automata of all shards would cost documents times
shards, so linear passes first find which reference text can hold a document's spans:

0. Of equal texts (by SHA-256) the first stands for all; the others are routed to it.
1. Every window of `least` words has a winnowing anchor (its least K-gram hash), and equal
   windows have equal anchors. A count of anchors, summed before the shuffle, shows those
   that occur twice; they go into a Bloom filter of fixed size.
2. Windows with such an anchor are hashed (96 bits); of equal windows in a batch only the
   first is shuffled, so a hot passage brings one row a batch. The least position of each
   hash becomes the source of all others; neighbours with neighbouring sources are one run.
3. Source texts, in blocks of BLOCK words that overlap by `least` - 1, form the reference
   shards: the places of a block that any run points to, merged in each task before they
   are shuffled. For each shard a suffix automaton with first positions is built, and the
   pieces of documents routed to it are streamed for matching statistics: a span goes where
   the automaton matches at least `least` words at an earlier position. A block that more
   than LOAD_WORDS words point to is a shard of its own, sent to as many tasks as its load
   asks for; the others are dealt out to shards by hash.

Only spans that an automaton has found are removed, whole copies included, so a clash of
hashes removes nothing. Earlier is: a smaller doc_id, or an earlier start. Ids that aren't
integers are ordered by a 64-bit hash. Rows that repeat an id and a text are one document
and each cut alike; with an id but not its text in common, rows are documents of their own
in an order by a hash of the text. Null, empty and short texts keep all words. Rows with a
null id are left as they are and are no source. Texts of any length are taken whole. Extra
columns pass through, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import Bloom, WordHash, discard, durable, free, ngrams, raw, reclaim, stored, tidied, tidied_groups

BITS = 27  # of the filter of anchors: 16 MB
BLOCK = 32_768  # words of a reference text
LOAD_WORDS = 400_000  # that are streamed past a shard, about
TURNS = 16
SLICE = 2500  # documents of which equal windows are found before the shuffle
SPANS = "array<struct<first:bigint,last:bigint>>"
WORD = re.compile(rb"[^ \t\n\x0b\x0c\r]+")


def anchors(h: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the K-grams, for every window the position of its anchor)."""
    k = max(1, least // 2)
    g = ngrams(h, k)
    w = least - k + 1
    if len(g) < w:
        return g, np.zeros(0, np.int64)
    return g, sliding_window_view(g, w).argmin(axis=1) + np.arange(len(g) - w + 1)


def repeated_anchors(docs: DataFrame, least: int) -> DataFrame:
    def run(batches):
        hashed = WordHash()
        for batch in (b.slice(lo, SLICE) for b in batches for lo in range(0, b.num_rows, SLICE)):
            found = [np.zeros(0, np.uint64)]
            for t in raw(batch.column(0)):
                g, at = anchors(hashed.of((t or b"").split()), least)
                found.append(g[np.unique(at)])
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], names=["h", "n"])

    return docs.select("text").mapInArrow(tidied(run), "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def windows(docs: DataFrame, bloom: Bloom, least: int) -> DataFrame:
    """Windows that may be repeated: h, check (two hashes), doc_id, tie, start; the source if it is in the same batch."""
    held, bits = docs.sparkSession.sparkContext.broadcast(bloom.data), bloom.bits

    def run(batches):
        hashed, bloom = WordHash(), Bloom(bits, held.value)
        for batch in (b.slice(lo, SLICE) for b in batches for lo in range(0, b.num_rows, SLICE)):
            hs, cs, ss, size, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [], []
            for i, t in enumerate(raw(batch.column(2))):
                h = hashed.of((t or b"").split())
                g, at = anchors(h, least)
                s = np.flatnonzero(bloom.has(g)[at]) if len(at) else at
                if len(s):
                    hs.append(ngrams(h, least)[s])
                    cs.append((ngrams(h ^ (h >> np.uint64(32)), least)[s] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                    ss.append(s)
                    size.append(len(s))
                    rows.append(i)
            rows, size = np.array(rows, np.int64), np.array(size, np.int64)
            ids, ties = batch.column(0).to_numpy()[rows], batch.column(1).to_numpy()[rows]
            d, t = np.repeat(ids, size), np.repeat(ties, size)
            h, c, s = np.concatenate(hs), np.concatenate(cs), np.concatenate(ss)
            order = np.lexsort((s, t, d, c, h))
            h, c, d, t, s = h[order], c[order], d[order], t[order], s[order]
            head = np.ones(len(h), bool)
            head[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            first = np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))
            same = head | ((d == d[first]) & (t == t[first]) & (s == s[first]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(c), pa.array(d), pa.array(t), pa.array(s.astype(np.int32)), pa.array(d[first], mask=same), pa.array(t[first], mask=same), pa.array(s[first].astype(np.int32), mask=same)],
                names=["h", "check", "doc_id", "tie", "start", "src", "src_tie", "src_start"],
            )

    return docs.select("doc_id", "tie", "text").mapInArrow(tidied(run), "h long, check int, doc_id long, tie int, start int, src long, src_tie int, src_start int")


RUNS = "array<struct<start:bigint,length:bigint,src_start:bigint>>"
PLACES = "array<struct<first:bigint,last:bigint>>"
SOURCE = ["src", "src_tie", "block"]


def runs(found: DataFrame, least: int) -> DataFrame:
    """(doc_id, tie, src, src_tie, block, n, runs): windows joined to runs (start, length in words, start in the source); one row for each pair of document and block of a source."""

    def changes(*columns) -> np.ndarray:
        out = np.ones(len(columns[0]), bool)
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        return out

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            start, src, tie, at = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
            order = np.lexsort((at, tie, src, start, row))
            row, start, src, tie, at = (x[order] for x in (row, start, src, tie, at))
            one = changes(row, start)  # of several sources of a window (from rows that repeat), the first
            row, start, src, tie, at = (x[one] for x in (row, start, src, tie, at))
            block = at // BLOCK
            new = changes(row, src, tie, block, at - start)
            new[1:] |= start[1:] != start[:-1] + 1
            head = np.flatnonzero(new)
            length = np.diff(np.append(head, len(row))) + least - 1
            row, start, src, tie, at, block = (x[head] for x in (row, start, src, tie, at, block))
            order = np.lexsort((start, block, tie, src, row))
            row, start, src, tie, at, block, length = (x[order] for x in (row, start, src, tie, at, block, length))
            head = np.flatnonzero(changes(row, src, tie, block))
            each = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(at)], names=["start", "length", "src_start"])
            offsets = pa.array(np.append(head, len(row)).astype(np.int32))
            n = np.add.reduceat(length, head) if len(head) else head
            of = pa.array(row[head])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(of), batch.column(1).take(of), pa.array(src[head]), pa.array(tie[head].astype(np.int32)), pa.array(block[head]), pa.array(n), pa.ListArray.from_arrays(offsets, each)],
                names=["doc_id", "tie", *SOURCE, "n", "runs"],
            )

    # a document's windows, never more than its words
    by = found.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "src", "src_tie", "src_start")).alias("ws"))
    return by.mapInArrow(tidied(run), f"doc_id long, tie int, src long, src_tie int, block long, n long, runs {RUNS}")


def union_of(places: list) -> list:
    """The union of intervals (first, last), those that touch joined."""
    out: list = []
    for a, b in sorted(places):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def unions(keys: list, first: np.ndarray, last: np.ndarray, n: np.ndarray) -> tuple:
    """(keys, first, last, n, index of the key): intervals sorted and joined by key where they touch; n summed by key, at its first interval."""
    order = np.lexsort((first, *keys[::-1]))
    keys, first, last, n = [k[order] for k in keys], first[order], last[order], n[order]
    new = np.ones(len(first), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    of = np.cumsum(new) - 1
    apart = of << np.int64(40)  # no text has so many words, so the running greatest end starts anew with each key
    ends = np.maximum.accumulate(last + apart)
    head = np.ones(len(first), bool)
    head[1:] = (first + apart)[1:] > ends[:-1]
    at = np.flatnonzero(head)
    total = np.zeros(len(at), np.int64)
    if len(at):
        ends = np.maximum.reduceat(ends, at) - apart[at]
        total[new[at]] = np.add.reduceat(n, np.flatnonzero(new))
    return [k[at] for k in keys], first[at], ends, total, of[at]


def references(each: DataFrame) -> DataFrame:
    """(src, src_tie, block, n, places) of rows (..., n, runs): a row for each block that runs point to, with the places in it (first, last).

    Places are merged within each task, then by part of the tasks, then by block, so that a
    source with many copies sends a row a task and no more places than its block has words.
    """
    kind = f"src long, src_tie int, block long, part int, n long, places {PLACES}"

    def merged(parts):
        """parts (keys, first, last, n) to record batches; a key may come again in a later one."""
        held, size = [], 0

        def joined():
            return unions([np.concatenate([h[0][i] for h in held]) for i in range(4)], *(np.concatenate([h[i] for h in held]) for i in (1, 2, 3)))

        def batch(keys, first, last, n, of):
            new = np.ones(len(of), bool)
            new[1:] = of[1:] != of[:-1]
            head = np.flatnonzero(new)
            rows = pa.StructArray.from_arrays([pa.array(first), pa.array(last)], names=["first", "last"])
            kinds = (np.int64, np.int32, np.int64, np.int32)
            places = pa.ListArray.from_arrays(pa.array(np.append(head, len(of)).astype(np.int32)), rows)
            return pa.RecordBatch.from_arrays([*(pa.array(k[head].astype(t)) for k, t in zip(keys, kinds)), pa.array(n[head]), places], names=["src", "src_tie", "block", "part", "n", "places"])

        for part in parts:
            held.append(part)
            size += len(part[1])
            if size > 400_000:
                out = joined()
                if len(out[1]) > 200_000:
                    yield batch(*out)
                    held, size = [], 0
                else:
                    held, size = [out[:4]], len(out[1])
        if size:
            yield batch(*joined())

    def at_head(n: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """n at the first of each row's places, 0 at the others."""
        out = np.zeros(int(counts.sum()), np.int64)
        out[(np.cumsum(counts) - counts)[counts > 0]] = n[counts > 0]
        return out

    def pointed(batches):
        def parts():
            for batch in batches:
                counts = np.diff(batch.column(4).offsets.to_numpy())
                flat = batch.column(4).flatten()
                first, length = (flat.field(i).to_numpy(zero_copy_only=False) for i in (2, 1))
                keys = [np.repeat(batch.column(i).to_numpy().astype(np.int64), counts) for i in range(3)]
                yield [*keys, np.zeros(len(first), np.int64)], first, first + length, at_head(batch.column(3).to_numpy(), counts)

        yield from merged(parts())

    def summed(batches):
        def parts():
            for batch in batches:
                lists = batch.column(5)
                inner = lists.flatten()
                each_ = np.diff(inner.offsets.to_numpy())
                row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                counts = np.bincount(row, each_, batch.num_rows).astype(np.int64)
                flat = inner.flatten()
                keys = [np.repeat(batch.column(i).to_numpy().astype(np.int64), counts) for i in range(4)]
                yield keys, *(flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)), at_head(batch.column(4).to_numpy(), counts)

        yield from merged(parts())

    out = each.select(*SOURCE, "n", "runs").mapInArrow(tidied(pointed), kind).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    for part in (F.col("part"), F.lit(0)):
        by = out.groupBy(*SOURCE, part.alias("part")).agg(F.sum("n").alias("n"), F.collect_list("places").alias("places"))
        out = by.select(*SOURCE, "part", "n", "places").mapInArrow(tidied(summed), kind)
    return out.drop("part")


class Automaton:
    """Suffix automaton over words; `first` holds the first end position of a state's strings."""

    def __init__(self):
        self.next, self.link, self.length, self.first, self.last = [{}], [-1], [0], [-1], 0

    def extend(self, words: list, position: int) -> None:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = self.last
        for c in words:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            first.append(position)
            position += 1
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(nxt[q].copy())
                    length.append(length[p] + 1)
                    first.append(first[q])
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.last = last

    def separate(self) -> None:
        """What follows is another text: no match runs on."""
        self.last = 0

    def matches(self, words: list, least: int):
        """(end, first end position in the reference of the last `least` words) wherever so many match."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        v = n = 0
        for i, c in enumerate(words):
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c in nxt[v]:
                v, n = nxt[v][c], n + 1
                if n >= least:
                    u = v
                    while length[link[u]] >= least:
                        u = link[u]
                    v, n = u, min(n, length[u])  # matches of `least` words are all that count
                    yield i, first[u]


def confirm(docs: DataFrame, each: DataFrame, least: int) -> DataFrame:
    """(doc_id, tie, spans: array of first and last + 1 word) as the automata of the reference shards say."""
    table = stored(references(each))
    heavy = F.col("n") > LOAD_WORDS
    words = table.agg(F.sum(F.when(~heavy, F.col("n"))).alias("n")).first()["n"] or 0
    shards = max(1, -(-2 * words // LOAD_WORDS))
    mine = F.xxhash64(*SOURCE)  # a shard of its own: below 0
    refs = table.withColumn("salts", F.ceil(F.greatest(F.lit(1), F.col("n") / LOAD_WORDS)).cast("int")).withColumn("key", F.when(heavy, -1 - mine.bitwiseAND((1 << 62) - 1)).otherwise(F.pmod(mine, F.lit(shards))))
    # a row for each turn, since a heavy block may have a third of all rows
    hot = refs.where(heavy).select(*SOURCE, F.col("salts").alias("__salts"), F.explode(F.sequence(F.lit(0), F.lit(TURNS - 1))).alias("turn"))
    sharded = each.withColumn("turn", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(TURNS)).cast("int")).join(hot, [*SOURCE, "turn"], "left")
    key = F.when(F.col("__salts").isNotNull(), -1 - mine.bitwiseAND((1 << 62) - 1)).otherwise(F.pmod(mine, F.lit(shards)))
    salt = F.pmod(F.xxhash64("doc_id", "tie", F.lit(7)), F.coalesce("__salts", F.lit(1))).cast("int")
    part = lambda reference, key, salt, places: F.struct(F.lit(reference).alias("reference"), key.alias("key"), salt.alias("salt"), places.alias("places"))
    places = F.transform("runs", lambda r: F.struct(r["start"].alias("first"), (r["start"] + r["length"]).alias("last")))
    pieces = sharded.select("doc_id", "tie", part(False, key, salt, places))
    held = refs.select("src", "src_tie", part(True, F.col("key"), F.col("salts"), F.col("places")))
    wanted = stored(pieces.union(held).toDF("doc_id", "tie", "p").groupBy("doc_id", "tie").agg(F.collect_list("p").alias("ps")))
    ids = wanted.select(F.xxhash64("doc_id").alias("h"))
    texts = Bloom.build(ids, "h").keep(docs, "doc_id").dropDuplicates(["doc_id", "tie"]).join(wanted, ["doc_id", "tie"])
    kinds = {"key": pa.int64(), "salt": pa.int32(), "reference": pa.bool_(), "doc_id": pa.int64(), "tie": pa.int32(), "start": pa.int64(), "words": pa.binary()}

    def cut(batches):
        out: dict = {k: [] for k in kinds}

        def batch_of():
            made = pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in out.items()], names=list(out))
            for v in out.values():
                v.clear()
            return made

        size = 0
        for batch in batches:
            for i, (d, tie) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                words = (batch.column(2)[i].as_py() or "").encode().split()
                spans: dict = {}
                for p in batch.column(3)[i].as_py():
                    spans.setdefault((p["key"], p["salt"], p["reference"]), []).extend((r["first"], r["last"]) for r in p["places"])
                for (key, salt, reference), some in spans.items():
                    for a, b in union_of(some):  # spans that touch are one text
                        text = b" ".join(words[a:b])
                        for one in range(salt) if reference else (salt,):
                            for k, v in zip(out, (key, one, reference, d, tie, a, text)):
                                out[k].append(v)
                            size += len(text)
                            if size > 4_000_000:
                                yield batch_of()
                                size = 0
        yield batch_of()

    cutted = texts.select("doc_id", "tie", "text", "ps").mapInArrow(tidied(cut), "key long, salt int, reference boolean, doc_id long, tie int, start long, words binary")

    def shard_task(t: pa.Table) -> pa.Table:
        cols = [t.column(c).to_pylist() for c in ("reference", "doc_id", "tie", "start", "words")]
        rows = sorted(zip(*cols), key=lambda r: (not r[0], *r[1:4]))
        auto, at, places, begins = Automaton(), 0, [], []
        ids, ties, lo, hi = [], [], [], []
        for reference, d, tie, start, text in rows:
            words = text.split()
            if reference:
                auto.separate()
                begins.append(at)
                places.append((d, tie, start))
                auto.extend(words, at)
                at += len(words)
                continue
            spans: list = []
            for i, end in auto.matches(words, least):
                k = bisect.bisect_right(begins, end) - 1
                src, src_tie, first = places[k]
                if (src, src_tie, first + end - begins[k]) < (d, tie, start + i):
                    first, last = start + i - least + 1, start + i + 1
                    if spans and first <= spans[-1][1]:
                        spans[-1][1] = last
                    else:
                        spans.append([first, last])
            for first, last in spans:
                ids.append(d), ties.append(tie), lo.append(first), hi.append(last)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "tie": pa.array(ties, pa.int32()), "first": pa.array(lo, pa.int64()), "last": pa.array(hi, pa.int64())})

    spans = cutted.groupBy("key", "salt").applyInArrow(tidied_groups(shard_task, 8), "doc_id long, tie int, first long, last long")
    out = durable(spans.groupBy("doc_id", "tie").agg(F.collect_set(F.struct("first", "last")).alias("spans")))
    discard(table)
    discard(wanted)
    return out


def copies(docs: DataFrame, least: int) -> DataFrame:
    """Documents (doc_id, tie) whose text is that of an earlier one, and may be long enough to hold a window, as rows of runs() that point to it.

    The number of words isn't known here: runs cover the text's blocks, and what is past its
    end is empty.
    """
    size = F.octet_length("text")
    keyed = durable(docs.where(size >= 2 * least - 1).select("doc_id", "tie", size.alias("size"), F.unhex(F.sha2("text", 256)).alias("key")))
    me = F.struct("doc_id", "tie")
    first = keyed.groupBy("key").agg(F.min(me).alias("first"), F.max(me).alias("last")).where("first != last").drop("last")
    first = durable(first)  # both sides of the join come from plain shuffles, so a hot text can be split
    found = keyed.join(first, "key").where(me > F.col("first")).dropDuplicates(["doc_id", "tie"])
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") + 1) / (2 * BLOCK)).cast("long"))
    found = found.select("doc_id", "tie", F.col("first.doc_id").alias("src"), F.col("first.tie").alias("src_tie"), F.ceil(F.col("size") / 6).cast("long").alias("n"), F.explode(blocks).alias("block"))
    at = F.col("block") * BLOCK
    run = F.array(F.struct(at.alias("start"), F.lit(BLOCK + least - 1).cast("long").alias("length"), at.alias("src_start")))
    return found.select("doc_id", "tie", *SOURCE, F.least("n", F.lit(BLOCK)).alias("n"), run.alias("runs"))


def repeated_spans(docs: DataFrame, least: int = 20) -> DataFrame:
    """(doc_id, tie, spans) for the documents (doc_id long, tie, text) that repeat something earlier."""
    same = stored(copies(docs, least))
    # only the first of equal texts is searched for windows; of what the filter picks out, the rows that aren't copies
    twice = Bloom.build(same.select(F.xxhash64("doc_id").alias("h")).distinct(), "h")
    passed = durable(twice.keep(docs, "doc_id").join(same.select("doc_id", "tie"), ["doc_id", "tie"], "left_anti"))
    firsts = twice.keep(docs, "doc_id", inside=False).union(passed)
    bloom = Bloom.build(repeated_anchors(firsts, least), "h", BITS)
    rows = stored(windows(firsts, bloom, least))
    reclaim(docs.sparkSession)
    order = Window.partitionBy("h", "check").orderBy("doc_id", "tie", "start")  # a row a batch at most
    source = [F.first(c).over(order).alias(s) for c, s in (("doc_id", "src"), ("tie", "src_tie"), ("start", "src_start"))]
    heads = rows.where("src IS NULL").select("h", "check", "doc_id", "tie", "start", *source)
    found = heads.where("doc_id != src OR tie != src_tie OR start != src_start").drop("h", "check").union(rows.where("src IS NOT NULL").drop("h", "check"))
    each = stored(runs(found, least).union(same))
    discard(rows)
    del rows, order, heads, found
    reclaim(docs.sparkSession)
    out = confirm(docs, each, least)
    discard(each)
    discard(same)
    reclaim(docs.sparkSession)
    return out


def covered(n: int, spans: list) -> np.ndarray:
    out = np.zeros(n + 1, np.int32)
    for s in spans:
        out[min(n, s["first"])] += 1
        out[min(n, s["last"])] -= 1
    return np.cumsum(out[:n]) > 0


def with_spans(docs: DataFrame, least: int, spans: str) -> tuple[DataFrame, DataFrame]:
    """(documents that may have spans, with these in the column named; the others), by a filter on ids: only the former are shuffled."""
    whole = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    mine = F.col("doc_id").cast("long") if whole else F.xxhash64("doc_id")
    tie = F.hash("text")
    texts = docs.where(F.col("doc_id").isNotNull()).select(mine.alias("doc_id"), tie.alias("tie"), "text")
    marks = repeated_spans(texts, least)
    bloom = Bloom.build(marks.select(F.xxhash64("doc_id").alias("h")), "h")
    a, b = free(docs, "id"), free(docs, "tie")
    marks = marks.select(F.col("doc_id").alias(a), F.col("tie").alias(b), F.col("spans").alias(spans))
    named = docs.withColumns({a: F.when(F.col("doc_id").isNotNull(), mine), b: tie})
    maybe = bloom.keep(named, a).join(marks, [a, b], "left").drop(a, b)
    return maybe, bloom.keep(named, a, inside=False).drop(a, b).withColumn(spans, F.array().cast(SPANS))


def digests(docs: DataFrame, least: int = 20) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                size, gone, sha = [], [], []
                for t, spans in zip(raw(part.column(1)), part.column(2).to_pylist()):
                    words = (t or b"").split()
                    kept = [w for w, x in zip(words, covered(len(words), spans).tolist()) if not x] if spans else words
                    size.append(len(words))
                    gone.append(len(words) - len(kept))
                    sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    out = [x.select("doc_id", "text", "spans").mapInArrow(tidied(run), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string") for x in with_spans(docs.select("doc_id", "text"), least, "spans")]
    return out[0].union(out[1])


def remove(docs: DataFrame, least: int = 20) -> DataFrame:
    """docs with the repeated spans cut out of text; the white space between kept words stays."""
    columns, extra = docs.columns, free(docs, "spans")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = columns.index("text")

    def run(batches):
        for batch in batches:
            out = []
            for t, spans in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist()):
                if t and spans:
                    b = t.encode()
                    words = [m.start() for m in WORD.finditer(b)]
                    edges = np.array([*words, len(b)])
                    keep = ~covered(len(words), spans)
                    t = b"".join([b[: edges[0]], *[b[edges[i] : edges[i + 1]] for i in np.flatnonzero(keep)]]).decode()
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(len(columns))], names=columns)

    maybe, rest = with_spans(docs, least, extra)
    return maybe.select(*columns, extra).mapInArrow(tidied(run), fields).union(rest.select(*columns))
