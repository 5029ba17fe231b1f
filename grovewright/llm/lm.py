"""LM scoring by a log-bilinear model trained with noise-contrastive estimation.

Counts. Words of the training texts are counted over all data (batches first, then one
shuffle of narrow rows). The HEAD most frequent words go to all executors; counts of the
other words reach the documents by a join, so nothing broadcast grows with the data.

Model. P(word | context) = P(class | context) * P(word | class). Each of the TOP most
frequent words and the end are classes of their own; other words are in classes by their
last two bytes, within which P is (count + 0.1) over the class's sum (with one unknown
word a class). P(class | context) is log-bilinear: the context vector is the sum of the
last CONTEXT words' vectors, each scaled by a vector of its distance; its products with
the class vectors, plus biases, are normalised over all classes by one matrix product a
block of tokens.

Training. Texts are encoded once and dealt by a hash of id and text to training parts of
about PART_TOKENS tokens, and within these, by the same hash, to ROUNDS rounds, fixed
shares of the data. In a round each part trains a copy of the model on its texts in the
order of their hashes; then the parameters (and the sums of squared gradients that set
the step sizes) are averaged by tokens, in two levels of sums on executors, and the next
round goes on from there. So each text is trained on once, and the model depends on the
rows alone, not on how they are partitioned.

Null and empty texts are one end. Repeated rows get a row each. Extra columns are ignored.
Without training texts all counts are 0 and both scores are those of an empty model.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE, Shared, WordHash, discard, fold, raw, stored, tidied, tidied_groups

HEAD, TOP, ENDINGS, INPUTS, DIM, CONTEXT = 100_000, 128, 63, 4096, 16, 3
NOISE, BLOCK, RATE = 32, 8192, 0.1
PART_TOKENS, ROUNDS = 2_000_000, (1 / 16, 1 / 4, 1 / 2, 1)  # the rounds' shares, summed up
SCORED = 1024  # tokens scored at once: their products with all classes stay in the cache
SMOOTH = 0.1
CHUNK = 16_384


def ending(word: bytes) -> int:
    return int.from_bytes(word[-2:], "big")


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, ending, c) for all words of docs, and the end as h null with the number of documents."""

    def run(batches):
        hashed, ends = WordHash(), {}
        for batch in batches:
            every = [t.lower().split() for t in (x or b"" for x in raw(batch.column(0)))]
            flat = [w for ws in every for w in ws]
            h = hashed.of(flat).view(np.int64)
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            e = np.fromiter((ending(flat[i]) for i in first.tolist()), np.int32, len(first))
            yield pa.RecordBatch.from_arrays([pa.array([*u.tolist(), None], pa.int64()), pa.array([*e.tolist(), -1], pa.int32()), pa.array([*n.tolist(), len(every)], pa.int64())], names=["h", "ending", "c"])

    return docs.select("text").mapInArrow(tidied(run), "h long, ending int, c long").groupBy("h", "ending").agg(F.sum("c").alias("c")).where("c > 0")


@dataclass
class Vocabulary:
    """The head and the classes. Codes: 0..head-1 head words by frequency, then one for each ending class, then the end."""

    hashes: np.ndarray  # of head words, sorted
    codes: np.ndarray  # of these
    log_count: np.ndarray  # by code; 0 for words whose count comes by the join
    class_of: np.ndarray
    input_of: np.ndarray
    endings: dict[int, int]  # ending -> number of its class among the ending classes
    log_mass: np.ndarray  # log10 of a class's sum
    noise: np.ndarray  # share of each class in training tokens
    tokens: int
    types: int
    end_count: int

    @property
    def head(self) -> int:
        return len(self.hashes)

    @property
    def start(self) -> int:
        return self.head + ENDINGS + 2

    @property
    def end(self) -> int:
        return self.head + ENDINGS + 1


def vocabulary(counts: DataFrame) -> Vocabulary:
    words = counts.where("h IS NOT NULL")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("h").isNull(), F.col("c"))).alias("d")).first()
    # the head is all words from some frequency on, so that HEAD rows at most leave the executors
    step = F.floor(F.log2("c") * 16).cast("int")
    sizes, cut, n = sorted(words.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True), None, 0
    for r in sizes:
        if n + r["n"] > HEAD:
            break
        n, cut = n + r["n"], r["step"]
    top = [] if cut is None else sorted(words.where(step >= cut).collect(), key=lambda r: (-r["c"], r["h"]))
    by_end = words.groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()  # 2**16 rows at most
    mass, kinds = {r["ending"]: r["c"] for r in by_end}, {r["ending"]: r["v"] for r in by_end}
    for r in top[:TOP]:
        mass[r["ending"]] -= r["c"]
        kinds[r["ending"]] -= 1
    endings = {e: i for i, e in enumerate(sorted(mass, key=lambda e: (-mass[e], e))[:ENDINGS])}
    head, n_top = len(top), min(TOP, len(top))
    codes = head + ENDINGS + 3
    class_of, input_of, log_count = np.zeros(codes, np.int64), np.zeros(codes, np.int64), np.zeros(codes)
    word_inputs = min(INPUTS, head)
    for k, r in enumerate(top):
        class_of[k] = k if k < n_top else n_top + endings.get(r["ending"], ENDINGS)
        input_of[k] = k if k < word_inputs else word_inputs + endings.get(r["ending"], ENDINGS)
        log_count[k] = math.log10(r["c"] + SMOOTH)
    rest = np.arange(ENDINGS + 1)
    class_of[head : head + ENDINGS + 1], input_of[head : head + ENDINGS + 1] = n_top + rest, word_inputs + rest
    class_of[-2:], input_of[-2:] = n_top + ENDINGS + 1, word_inputs + ENDINGS + 1
    end_count = total["d"] or 0
    log_count[-2] = math.log10(end_count + SMOOTH)
    z = np.zeros(n_top + ENDINGS + 2)
    share = z.copy()
    z[:n_top], share[:n_top] = [r["c"] + SMOOTH for r in top[:n_top]], [r["c"] for r in top[:n_top]]
    z[n_top:-1] = SMOOTH  # the unknown word of the class
    for e, c in mass.items():
        k = n_top + endings.get(e, ENDINGS)
        z[k] += c + SMOOTH * kinds[e]
        share[k] += c
    z[-1], share[-1] = end_count + SMOOTH, end_count
    share = (share + 0.5) / (share + 0.5).sum()
    hashes = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], order, log_count, class_of, input_of, endings, np.log10(z), share, total["n"] or 0, total["v"] or 0, end_count)


class Codes(dict):
    """word -> code"""

    def __init__(self, v: Vocabulary):
        self.v, self.head = v, dict(zip(v.hashes.tolist(), v.codes.tolist()))

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        c = self.head.get(xxhash.xxh64_intdigest(word) ^ (1 << 63))
        if c is None:
            c = self.v.head + self.v.endings.get(ending(word), ENDINGS)
        self[word] = c
        return c


def laid_out(texts: list[list[bytes]], codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all texts, each after CONTEXT starts and before its end; places of the tokens proper)"""
    v, parts, places, at = codes.v, [], [], 0
    lead, tail = np.full(CONTEXT, v.start), np.array([v.end])
    for words in texts:
        parts += [lead, np.fromiter(map(codes.__getitem__, words), np.int64, len(words)), tail]
        places.append(np.arange(at + CONTEXT, at + CONTEXT + len(words) + 1))
        at += CONTEXT + len(words) + 1
    return np.concatenate(parts), np.concatenate(places)


@dataclass
class Model:
    r: np.ndarray  # word vectors by input
    c: np.ndarray  # scale of each distance
    q: np.ndarray  # class vectors
    b: np.ndarray  # biases
    g: list = field(default_factory=list)  # squared gradients so far

    @staticmethod
    def fresh(v: Vocabulary) -> Model:
        rng = np.random.default_rng(0)
        inputs, classes = int(v.input_of.max()) + 1, len(v.noise)
        small = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        return Model(small(inputs, DIM), np.ones((CONTEXT, DIM), np.float32), small(classes, DIM), np.log(v.noise).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.r, self.c, self.q, self.b)]).astype(np.float32)

    def of(self, flat: np.ndarray) -> Model:
        out, at = [], 0
        for x in (self.r, self.c, self.q, self.b):
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Model(*out)

    def state(self) -> np.ndarray:
        """Parameters and squared gradients, in one."""
        g = self.g or [np.full_like(x, 1e-2) for x in (self.r, self.c, self.q, self.b)]
        return np.concatenate([self.flat(), *[x.ravel() for x in g]]).astype(np.float32)

    def resumed(self, state: np.ndarray) -> Model:
        half = len(state) // 2
        out, g = self.of(state[:half]), self.of(state[half:])
        out.g = [g.r, g.c, g.q, g.b]
        return out

    def contexts(self, inputs: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        before = [inputs[at - 1 - i] for i in range(CONTEXT)]
        p = self.r[before[0]] * self.c[0]
        for i in range(1, CONTEXT):
            p += self.r[before[i]] * self.c[i]
        return before, p

    def step(self, inputs: np.ndarray, classes: np.ndarray, at: np.ndarray, noise: np.ndarray, draw: np.ndarray) -> None:
        """One update by noise-contrastive estimation; the drawn noise classes serve all tokens of the block."""
        if not self.g:
            self.g = [np.full_like(x, 1e-2) for x in (self.r, self.c, self.q, self.b)]
        n, y = len(at), classes[at]
        before, p = self.contexts(inputs, at)
        k = np.float32(len(draw))
        logit = lambda s, c: 1 / (1 + np.exp(-np.clip(s - np.log(k * noise[c]), -30, 30)))
        qy, qn = self.q[y], self.q[draw]
        up = (1 - logit(np.einsum("td,td->t", p, qy) + self.b[y], y)).astype(np.float32)
        down = -logit(p @ qn.T + self.b[draw], draw).astype(np.float32)
        dp = up[:, None] * qy + down @ qn
        m = len(self.b)
        dq = spread(y, up[:, None] * p, m)
        db = np.bincount(y, up, m)
        np.add.at(dq, draw, down.T @ p)
        np.add.at(db, draw, down.sum(axis=0))
        dc = np.stack([np.einsum("td,td->d", self.r[before[i]], dp) for i in range(CONTEXT)])
        dr = spread(np.concatenate(before), np.concatenate([dp * self.c[i] for i in range(CONTEXT)]), len(self.r))
        for x, g, d in zip((self.r, self.c, self.q, self.b), self.g, (dr, dc, dq, db)):
            d = (d / np.float32(math.sqrt(n))).astype(np.float32)
            g += d * d
            x += np.float32(RATE) * d / np.sqrt(g)

    def log_class(self, inputs: np.ndarray, classes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 P(class | context), normalised over all classes."""
        _, p = self.contexts(inputs, at)
        s = p @ self.q.T
        s += self.b
        own = s[np.arange(len(at)), classes[at]].astype(float)
        with np.errstate(over="ignore"):
            total = (np.exp(s) @ np.ones(s.shape[1], np.float32)).astype(float)
        if not np.isfinite(total).all() or not total.all():  # logits beyond what exp can hold
            peak = s.max(axis=1, keepdims=True)
            total, own = np.exp(s - peak).sum(axis=1, dtype=np.float64), own - peak[:, 0]
        return (own - np.log(total)) / math.log(10)


def spread(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by index."""
    return np.stack([np.bincount(index, rows[:, j], n) for j in range(rows.shape[1])], axis=1)


def train_on(model: Model, v: Vocabulary, texts: list[np.ndarray], seed: int) -> int:
    """Train in place on encoded texts (codes after CONTEXT starts, the end among them); the number of tokens."""
    rng, tokens = np.random.default_rng(seed), 0
    noise = v.noise.astype(np.float32)
    cumulative = np.cumsum(v.noise)
    for lo in range(0, len(texts), 512):
        some = texts[lo : lo + 512]
        laid = np.concatenate(some)
        own = np.ones(len(laid), bool)
        begins = np.cumsum([0, *map(len, some)])[:-1]
        for k in range(CONTEXT):
            own[begins + k] = False
        at = np.flatnonzero(own)
        inputs, classes = v.input_of[laid], v.class_of[laid]
        tokens += len(at)
        rng.shuffle(at)
        for k in range(0, len(at), BLOCK):
            draw = np.minimum(np.searchsorted(cumulative, rng.random(NOISE)), len(noise) - 1)
            model.step(inputs, classes, at[k : k + BLOCK], noise, draw)
    return tokens


def encoded(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """(part, round, key, codes: 32-bit codes) of training texts (doc_id, text)."""
    held = Shared(docs.sparkSession, v)  # bounded by HEAD
    parts = max(1, -(-v.tokens // PART_TOKENS))
    key = F.xxhash64("doc_id", "text")
    share = F.pmod(key, F.lit(1 << 16)) / (1 << 16)
    turn = F.lit(len(ROUNDS) - 1)
    for i in reversed(range(len(ROUNDS) - 1)):
        turn = F.when(share < ROUNDS[i], i).otherwise(turn)
    rows = docs.select(F.pmod(F.shiftright(key, 16), F.lit(parts)).cast("int").alias("part"), turn.cast("int").alias("round"), key.alias("key"), "text")

    def run(batches):
        codes = Codes(held.value)
        lead, tail = [codes.v.start] * CONTEXT, [codes.v.end]
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out = [np.array([*lead, *map(codes.__getitem__, (t or b"").lower().split()), *tail], np.int32).tobytes() for t in raw(part.column(3))]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(out, pa.binary())], names=["part", "round", "key", "codes"])

    return rows.mapInArrow(tidied(run), "part int, round int, key long, codes binary")


def train(docs: DataFrame, v: Vocabulary) -> Model:
    """docs: the training texts (doc_id, text)."""
    spark = docs.sparkSession
    texts = stored(encoded(docs, v))
    held, shape = Shared(spark, v), Model.fresh(v)
    state = shape.state()
    salts = max(1, math.isqrt(-(-v.tokens // PART_TOKENS)))
    kind = "chunk int, salt int, part int, n long, v binary"

    def rows_of(flat: np.ndarray, n: int, salt: int, part: int) -> pa.Table:
        chunks = [flat[k : k + CHUNK].tobytes() for k in range(0, len(flat), CHUNK)]
        m = len(chunks)
        return pa.table({"chunk": pa.array(range(m), pa.int32()), "salt": pa.array([salt] * m, pa.int32()), "part": pa.array([part] * m, pa.int32()), "n": pa.array([n] * m, pa.int64()), "v": pa.array(chunks, pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        acc = None
        for x in t.sort_by("part").column("v"):  # in one order, for the same sum to the last digit
            one = np.frombuffer(x.as_buffer(), np.float64)
            acc = one.copy() if acc is None else acc + one
        return pa.table({"chunk": t.column("chunk").slice(0, 1), "salt": pa.array([0], pa.int32()), "part": t.column("salt").slice(0, 1), "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()), "v": pa.array([acc.tobytes()], pa.binary())})

    for number in range(len(ROUNDS)):
        start = Shared(spark, state)

        def learn(t: pa.Table, number=number, start=start) -> pa.Table:
            t = t.sort_by("key")
            part = t.column("part")[0].as_py()
            model = shape.resumed(start.value)
            n = train_on(model, held.value, [np.frombuffer(x.as_buffer(), np.int32) for x in t.column("codes")], part * len(ROUNDS) + number)
            return rows_of(model.state().astype(np.float64) * n, n, part % salts, part)

        learned = texts.where(F.col("round") == number).groupBy("part").applyInArrow(tidied_groups(learn, 1), kind)  # PART_TOKENS codes, about
        sums = learned.groupBy("chunk", "salt").applyInArrow(add, kind).groupBy("chunk").applyInArrow(add, kind)
        rows = sums.orderBy("chunk").collect()  # one model
        if rows:
            state = np.concatenate([np.frombuffer(bytes(r["v"]), np.float64) / r["n"] for r in rows]).astype(np.float32)
    discard(texts)
    return shape.resumed(state)


def score(docs: DataFrame, counts: DataFrame, v: Vocabulary, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    held, given = Shared(spark, v), Shared(spark, model)
    kind = docs.schema[id_column].dataType.simpleString()
    base_unit = math.log10(v.tokens + SMOOTH * (v.types + 1)) if v.tokens or v.types else math.log10(SMOOTH)
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.xxhash64(id_column, text_column).alias("row"))

    def run(batches):
        v, model = held.value, given.value
        codes, hashed = Codes(v), WordHash()
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                texts = [(t or b"").lower().split() for t in raw(part.column(1))]
                laid, at = laid_out(texts, codes)
                inputs, classes = v.input_of[laid], v.class_of[laid]
                log_class = np.concatenate([model.log_class(inputs, classes, at[k : k + SCORED]) for k in range(0, len(at), SCORED)])
                size = np.array([len(t) + 1 for t in texts])
                begins = np.cumsum(size) - size
                sums = lambda x, begins=begins: pa.array(np.add.reduceat(x, begins))
                own = laid[at]
                rare = np.flatnonzero((own >= v.head) & (own != v.end))
                whose = np.repeat(np.arange(len(texts)), size)[rare]
                h = hashed.of([texts[i][j] for i, j in zip(whose.tolist(), (rare - begins[whose]).tolist())]).view(np.int64)
                order = np.lexsort((h, whose))
                whose, h = whose[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (whose[1:] != whose[:-1]) | (h[1:] != h[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(h))).astype(np.int32)
                offsets = pa.array(np.searchsorted(whose[first], np.arange(len(texts) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(2), pa.array(size), sums(((own < v.head) | (own == v.end) & (v.end_count > 0)).astype(np.int64)), sums(v.log_count[own]), sums(log_class - v.log_mass[classes[at]]),
                        pa.ListArray.from_arrays(offsets, pa.array(h[first])), pa.ListArray.from_arrays(offsets, pa.array(times)),
                    ],
                    names=["doc_id", "row", "n_tokens", "known", "log_counts", "log_classes", "hs", "ns"],
                )

    scored = source.select("doc_id", "text", "row").mapInArrow(tidied(run), f"doc_id {kind}, row long, n_tokens long, known long, log_counts double, log_classes double, hs array<long>, ns array<int>")
    scored = stored(scored)  # so that texts are read once for both uses
    near = scored.drop("hs", "ns")
    far = scored.select("row", F.posexplode(F.arrays_zip("hs", "ns")).alias("at", "x")).select("row", F.col("x.hs").alias("h"), F.col("x.ns").alias("n"), (F.col("at") == 0).cast("int").alias("first"))
    c = F.coalesce("c", F.lit(0))
    far = (
        far.join(counts.where("h IS NOT NULL").select("h", "c"), "h", "left")
        .groupBy("row").agg(F.sum(F.col("n") * F.log10(c + SMOOTH)).alias("far"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("far_known"), F.sum("first").alias("times"))
        # rows that repeat bring their words as often as they occur
        .select("row", (F.col("far") / F.col("times")).alias("far"), (F.col("far_known") / F.col("times")).cast("long").alias("far_known"))
    )
    out = near.join(far, "row", "left")
    numerators = F.col("log_counts") + F.coalesce("far", F.lit(0.0))
    return out.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("far_known", F.lit(0))).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (numerators - F.col("n_tokens") * F.lit(base_unit)).alias("base_score"), (numerators + F.col("log_classes")).alias("score"),
    )


def score_corpus(docs: DataFrame, parts: int = 10) -> DataFrame:
    """Train on the documents whose fold is not 0, score all; adds held_out."""
    docs = docs.select("doc_id", "text")
    training = docs.where(fold("doc_id", parts) != 0)
    counts = stored(word_counts(training))
    v = vocabulary(counts)
    return score(docs, counts, v, train(training, v)).withColumn("held_out", fold("doc_id", parts) == 0)
