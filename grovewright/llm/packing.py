"""Best-fit packing planned over the histogram of piece lengths.

1. Each document is tokenised once, where it is read; tokens of a white-space delimited
   word don't depend on its neighbours, so ids are kept by word in a bounded cache. Only documents above the capacity are cut.
2. The histogram of piece lengths (at most `capacity` entries) goes to the driver, where
   best-fit decreasing runs over counts: a class of equal bins is one entry, so the plan
   has a few thousand runs whatever the number of documents.
3. A piece's rank within its length comes from salted groups (more salts for a more
   frequent length) plus the offsets of the salts; the rank finds the planned slot.

Null and empty texts are the closing id alone. Repeated rows are packed each on its own.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import array
import bisect
import codecs
import json
import re
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc, durable, raw, tidied

CACHE = 200_000  # words in each of two generations
SALT_ROWS = 2_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# The parts of a tokenizer file under which `Words` can split a word itself.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
# The same split for words of ASCII signs and Western letters, on which NFC has no effect.
PLAIN = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def byte_letters() -> dict[int, int]:
    """Byte-level BPE writes printable bytes as they are and the others, in order, as letters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}


class Words(dict):
    """word (bytes, without white space) -> its ids as little-endian uint32.

    The parts of words are entries as well. Of two generations of CACHE entries each the older
    one is dropped when the younger is full, and what is met again moves to the younger, so
    frequent words stay. Most words are split and given to the merges directly, which takes a third of the time
    of the whole tokenizer; all others, and all words under another kind of file, go
    through the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models

        self.tokenizer, self.old, self.merges = Tokenizer.from_file(path), {}, None
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        m, steps = j["model"], (j.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
        if (
            m.get("type", "BPE") == "BPE" and (j.get("normalizer") or {}).get("normalizers") == NORMALIZERS and steps[0].get("pattern") == {"Regex": SPLIT}
            and len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1]["add_prefix_space"] and not m.get("ignore_merges") and not m.get("unk_token")
        ):
            merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"]]
            self.merges = models.BPE(vocab=m["vocab"], merges=merges, end_of_word_suffix=m.get("end_of_word_suffix") or "", cache_capacity=0)
            letters = byte_letters()
            self.letters = "".join(chr(letters.get(b, b)) for b in range(256))

    def keep(self, word: bytes, ids: bytes) -> bytes:
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def part(self, text: str) -> bytes:
        word = text.encode()
        got = self.get(word)
        if got is None:
            got = self.old.get(word)
            if got is None:
                letters = text if text.isascii() else codecs.charmap_decode(word, "strict", self.letters)[0]
                got = array.array("I", [t.id for t in self.merges.tokenize(letters)]).tobytes()
            self.keep(word, got)
        return got

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            text = word.decode()
            if self.merges is not None and "<|" not in text and PLAIN.fullmatch(text):
                parts = PARTS.findall(text.lower())
                if parts == [text]:
                    return self.part(text)
                ids = b"".join(map(self.part, parts))
            else:
                ids = array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return self.keep(word, ids)


def encoder(path: str) -> Callable[[list[bytes]], list[bytes]]:
    """texts -> their ids as little-endian uint32; the word cache lives as long as the Python worker."""
    held = sys.__dict__.setdefault("_grovewright_words", {})
    if path not in held:
        held[path] = Words(path)
    ids = held[path].__getitem__
    # ASCII capitals never matter to these tokenizers, but for the spelling of special tokens
    lower = held[path].merges is not None
    return lambda texts: [b"".join(map(ids, (t.lower() if lower and b"<|" not in t else t).split())) for t in texts]


def cut_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, digest: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, and ids (binary, little-endian uint32) or, with digest, ids_crc32."""
    end = int(end_id).to_bytes(4, "little")
    kind = docs.schema[id_column].dataType.simpleString()
    last = "ids_crc32 long" if digest else "ids binary"

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows, piece, start, length, out = [], [], [], [], []
                for i, ids in enumerate(encode([t or b"" for t in raw(part.column(1))])):
                    ids += end
                    for k in range(0, len(ids), 4 * capacity):
                        one = ids[k : k + 4 * capacity]
                        rows.append(i)
                        piece.append(k // (4 * capacity))
                        start.append(k // 4)
                        length.append(len(one) // 4)
                        out.append(crc(one) if digest else one)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(out, pa.int64() if digest else pa.binary())],
                    names=["doc_id", "piece", "start", "length", last.split()[0]],
                )

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(tidied(run, words=True), f"doc_id {kind}, piece int, start long, length long, {last}")


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over counts: [(length -> how many in a sequence, how many such sequences)]."""
    open_: dict[int, list[tuple[tuple, int]]] = {}  # room left -> [(lengths placed, number of sequences)]
    rooms: list[int] = []

    def put(room: int, made: tuple, n: int) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append((made, n))

    for length in sorted(histogram, reverse=True):
        n, fresh = histogram[length], []
        while n:
            k = bisect.bisect_left(rooms, length)
            room, made, m = (rooms[k], *open_[rooms[k]].pop()) if k < len(rooms) else (capacity, (), n)
            if k < len(rooms) and not open_[room]:
                del open_[room]
                rooms.pop(k)
            fit = room // length
            full = min(m, n // fit)
            if full:
                fresh.append((room - fit * length, (*made, (length, fit)), full))
                n -= full * fit
            rest = m - full
            if rest and n:  # fewer than `fit` are left: one more sequence takes them
                fresh.append((room - n * length, (*made, (length, n)), 1))
                n, rest = 0, rest - 1
            if rest and made:
                put(room, made, rest)
        for room, made, m in fresh:
            put(room, made, m)
    return [(dict(made), m) for room in rooms for made, m in open_[room]]


def slots(plan: list[tuple[dict[int, int], int]], capacity: int) -> dict[str, np.ndarray]:
    """Runs of slots by (length, first rank): sequence, slots in a sequence, offset of the first."""
    taken: dict[int, int] = {}
    runs, first = [], 0
    for made, m in plan:
        offset = 0
        for length, each in sorted(made.items(), reverse=True):
            runs.append((length, taken.get(length, 0), first, each, offset))
            taken[length] = taken.get(length, 0) + m * each
            offset += length * each
        first += m
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 5)
    return {k: table[:, i].copy() for i, k in enumerate(("length", "rank", "sequence", "each", "offset"))}


def assign(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ...); pieces must be a stored table."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = slots(best_fit(histogram, capacity), capacity)
    salts = spark.createDataFrame([(k, -(-n // SALT_ROWS)) for k, n in histogram.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))).drop("salts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    # one row for every SALT_ROWS pieces
    starts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("local", local).join(starts, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("local") - 1)
    span = np.int64(1) << np.int64(48)
    key = runs["length"] * span + runs["rank"]

    def find(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False), np.int64) for c in ("length", "rank"))
            at = np.searchsorted(key, length * span + rank, side="right") - 1
            inside = rank - runs["rank"][at]
            each = runs["each"][at]
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(names))], pa.array(runs["sequence"][at] + inside // each), pa.array(runs["offset"][at] + inside % each * length)],
                names=[*names, "sequence_id", "offset"],
            )

    kept = pieces.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.select(*kept, "rank").mapInArrow(tidied(find), schema)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The packed pieces with their ids; sort by (sequence_id, offset) to lay sequences out."""
    pieces = cut_pieces(docs, path, capacity, end_id)
    stored = durable(pieces.withColumn("ids_crc32", F.crc32("ids")))
    placed = assign(stored.drop("ids"), capacity).withColumnRenamed("length", "size")
    return placed.join(stored.select(F.col("doc_id").alias("d"), F.col("piece").alias("p"), "ids_crc32", "ids").dropDuplicates(["d", "p", "ids_crc32"]).withColumnRenamed("ids_crc32", "c"),
                       (F.col("doc_id").eqNullSafe(F.col("d"))) & (F.col("piece") == F.col("p")) & (F.col("ids_crc32") == F.col("c"))).drop("d", "p", "c").withColumnRenamed("size", "length")


def pack_digests(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """pack() with the checksum of each piece's ids in place of the ids, which then are never shuffled."""
    return assign(durable(cut_pieces(docs, path, capacity, end_id, digest=True)), capacity)
