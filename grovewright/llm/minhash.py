"""Near-duplicates: SuperMinHash signatures, banding, verification, union-find.

A document's set holds hashes of its distinct k-word shingles (the whole sequence if it
has fewer words). Documents with equal sets are one class, stood for by the least id, so
copies cost no links. Signatures of ROWS * BANDS correlated ranks put classes in buckets;
two sets at similarity 0.8 share none of them with a chance of about 1e-7.

No pairs are listed within a bucket. First one leader, in an order of its own for each
bucket, is compared with the members on full sets. Links at the threshold make components,
resemblances of NEAR or more make clusters (a text drifts a long way in small steps). Then
only members of different components can still miss a link. Within a cluster, those
outside its largest component meet the others in tasks of two blocks of BLOCK documents;
across clusters, the same is done for buckets with several clusters. In a task, signatures
rule out most pairs (a similarity of 0.8 is estimated below CLEAR with a chance of about
1e-7), full sets decide on the others, and what is joined already is passed over. So each
pair that shares a bucket is linked, ruled out, or already in one component.

Empty, blank and null texts have no shingles and are linked with nothing. A null id is
linked with nothing and kept. Repeated rows get a row each; rows with one id and
different texts count as one document and are linked. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, WordHash, discard, durable, mix, ngrams, raw, reclaim, stored, tidied, tidied_groups
from .components import connected_components

ROWS, BANDS = 5, 40
BLOCK, CLEAR, NEAR = 1024, 0.65, 60
STEP = np.uint64(0x9E3779B97F4A7C15)
STEPS = np.arange(1, 1 + ROWS * BANDS, dtype=np.uint64) * STEP


def shingles(text: bytes, k: int, hashed: WordHash) -> np.ndarray:
    """Sorted distinct hashes."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = hashed.of(words)
    if len(words) < k:
        return ngrams(h, len(h)) + np.uint64(len(h))
    return np.unique(ngrams(h, k))


def signature(h: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash: element i sends rank j to the j-th slot of its own permutation of slots.

    The permutation is a Fisher-Yates shuffle run only as far as needed: once all slots
    hold a rank below j + 1, later steps can't change any.
    """
    n = len(h)
    out = np.full(m, np.iinfo(np.int64).max, np.int64)
    dense = np.tile(np.arange(m, dtype=np.int64), (n, 1)) if n < 512 else None
    rows, moved = np.arange(n), []
    for j in range(m):
        x = mix(h + STEPS[j])
        k = j + ((x >> np.uint64(32)) % np.uint64(m - j)).astype(np.int64)
        if dense is not None:
            slot, here = dense[rows, k], dense[:, j].copy()
            dense[rows, k] = here
        else:
            slot, here = k.copy(), np.full(n, j, np.int64)
            for at, value in moved:
                np.copyto(slot, value, where=at == k)
                np.copyto(here, value, where=at == j)
            moved.append((k, here))
        np.minimum.at(out, slot, (j << 32) | (x & np.uint64(0xFFFFFFFF)).astype(np.int64))
        if out.max() < (j + 1) << 32:
            break
    return out


def short(sig: np.ndarray) -> np.ndarray:
    """16 random bits of each rank: enough to tell ranks apart within a band or an estimate."""
    return (sig & 0xFFFF).astype(np.uint16)


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    parts = sig.astype(np.uint64).reshape(-1, rows)
    acc = np.arange(len(parts), dtype=np.uint64) * STEP
    for j in range(rows):
        acc = mix(acc + parts[:, j])
    return acc.view(np.int64)


def sketches(docs: DataFrame, k: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, key (hash of the set), sig (the signature)."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        hashed = WordHash()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                size, key, sig = [], [], []
                for t in raw(part.column(1)):
                    s = shingles(t or b"", k, hashed)
                    size.append(len(s))
                    key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sig.append(short(signature(s, ROWS * BANDS)).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "key", "sig"])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(tidied(run), f"doc_id {kind}, n_shingles long, key binary, sig binary")


def cells_of(classes: DataFrame) -> DataFrame:
    """(rep, band, cell)"""
    kind = classes.schema["rep"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                each = [bands(np.frombuffer(x, np.uint16)) for x in part.column(1).to_pylist()]
                at = pa.array(np.repeat(np.arange(len(each)), BANDS))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(each))), pa.array(np.concatenate([np.zeros(0, np.int64), *each]))], names=["rep", "band", "cell"])

    return classes.select("rep", "sig").mapInArrow(tidied(run), f"rep {kind}, band int, cell long")


def texts_of(docs: DataFrame, hashes: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, t) of the documents whose hashed id is in hashes (h), and of few others; only these are shuffled later."""
    return Bloom.build(hashes.distinct(), "h").keep(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("t")), "id")


def resemblance(p: np.ndarray, q: np.ndarray) -> tuple[int, int]:
    """(intersection, union), with an intersection of 0 where sizes alone rule out NEAR."""
    if 100 * min(len(p), len(q)) < NEAR * max(len(p), len(q)):
        return 0, 1
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both, len(p) + len(q) - both


def verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int, id_column: str, text_column: str) -> DataFrame:
    """The pairs (a, b) that resemble each other by NEAR percent or more, on the sets of their whole texts; linked: by `percent`."""
    kind = pairs.schema["a"].dataType.simpleString()
    texts = texts_of(docs, pairs.select(F.explode(F.array(F.xxhash64("a"), F.xxhash64("b"))).alias("h")), id_column, text_column)
    side = lambda c, t: texts.select(F.col("id").alias(c), F.col("t").alias(t))

    def run(batches):
        hashed, last, p = WordHash(), None, None
        for batch in (b.slice(lo, 128) for b in batches for lo in range(0, b.num_rows, 128)):
            keep, linked = [], []
            for x, y in zip(raw(batch.column(2)), raw(batch.column(3))):
                if x != last:  # rows come by a
                    last, p = x, shingles(x or b"", k, hashed)
                both, all_ = resemblance(p, shingles(y or b"", k, hashed))
                keep.append(100 * both >= NEAR * all_)
                linked.append(100 * both >= percent * all_)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])
            yield out.filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("b", "y"), "b").join(side("a", "x"), "a").select("a", "b", "x", "y").mapInArrow(tidied(run), f"a {kind}, b {kind}, linked boolean")


def dealt(state: DataFrame, key: str) -> DataFrame:
    """state (key, rep, comp, ...) in tasks (key, i, j): every two members of a key with different comp meet in one.

    Blocks of outsiders are numbered 0..n_out-1, blocks of the key's largest comp from n_out
    on; a task is a block of outsiders with itself or any later block, so members of the
    largest comp never meet.
    """
    most = state.groupBy(key, "comp").agg(F.count("*").alias("n")).groupBy(key).agg(F.max_by("comp", F.struct("n", "comp")).alias("most"), F.max("n").alias("inside"), F.sum("n").alias("all"))
    most = most.where("inside < all")
    sized = state.join(most, key).withColumns({
        "large": F.col("comp") == F.col("most"), "n_in": F.ceil(F.col("inside") / BLOCK).cast("int"), "n_out": F.ceil((F.col("all") - F.col("inside")) / BLOCK).cast("int"),
    })
    large = F.col("large")
    sized = sized.withColumn("block", F.when(large, F.col("n_out") + F.pmod(F.xxhash64("rep"), F.col("n_in"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("n_out"))).cast("int"))
    own = lambda i: F.struct(F.least(i, "block").alias("i"), F.greatest(i, "block").alias("j"))
    tasks = F.when(large, F.transform(F.sequence(F.lit(0), F.col("n_out") - 1), own)).otherwise(F.transform(F.sequence(F.lit(0), F.col("n_out") + F.col("n_in") - 1), own))
    return sized.select(*state.columns, "block", F.explode(tasks).alias("task")).select(*state.columns, "block", "task.i", "task.j")


def alike(t: pa.Table):
    """Pairs (x, y) of rows of a task with different comp and a similarity estimated at CLEAR or more, with where their ranks agree."""
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    sig = np.stack([np.frombuffer(x, np.uint16) for x in t.column("sig").to_pylist()])
    comp = np.unique(np.array(t.column("comp").to_pylist()), return_inverse=True)[1]
    block = t.column("block").to_numpy()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    for x in left.tolist():
        y = right[(comp[right] != comp[x]) & ((right > x) | (i != j))]
        same = sig[y] == sig[x]
        clear = same.mean(axis=1) >= CLEAR
        yield x, y[clear], same[clear], comp


def across(state: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of different comp that share a cell of state (cell, band, rep, comp) and look alike."""
    kind = classes.schema["rep"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        band, names, out = t.column("band")[0].as_py(), t.column("rep").to_pylist(), set()
        for x, ys, same, _ in alike(t):
            first = same.reshape(len(ys), BANDS, ROWS).all(axis=2).argmax(axis=1) == band  # in the pair's first common cell only
            out.update((min(names[x], names[y]), max(names[x], names[y])) for y in ys[first].tolist())
        pairs = sorted(out)
        return pa.table({"a": pa.array([a for a, _ in pairs], t.column("rep").type), "b": pa.array([b for _, b in pairs], t.column("rep").type)})

    return dealt(state, "cell").join(classes.select("rep", "sig"), "rep").groupBy("cell", "i", "j").applyInArrow(tidied_groups(run, 256), f"a {kind}, b {kind}").distinct()


def within(state: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, id_column: str, text_column: str) -> DataFrame:
    """Links (a, b) between different comp of a cluster of state (cluster, rep, comp): enough of them to join what belongs together."""
    kind = classes.schema["rep"].dataType.simpleString()
    texts = texts_of(docs, state.select(F.xxhash64("rep").alias("h")), id_column, text_column).withColumnRenamed("id", "rep")
    rows = dealt(state, "cluster").join(classes.select("rep", "sig"), "rep").join(texts, "rep")

    def run(t: pa.Table) -> pa.Table:
        names, text, hashed = t.column("rep").to_pylist(), t.column("t"), WordHash()
        sets: dict[int, np.ndarray] = {}
        top: dict[int, int] = {}

        def root(c: int) -> int:
            while top.get(c, c) != c:
                c = top[c]
            return c

        def of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingles((text[i].as_py() or "").encode(), k, hashed)
            return sets[i]

        a, b = [], []
        for x, ys, _, comp in alike(t):
            for y in ys.tolist():
                r, s = root(int(comp[x])), root(int(comp[y]))
                if r == s:
                    continue
                both, all_ = resemblance(of(x), of(y))
                if 100 * both >= percent * all_:
                    top[r] = s
                    a.append(names[x])
                    b.append(names[y])
        return pa.table({"a": pa.array(a, t.column("rep").type), "b": pa.array(b, t.column("rep").type)})

    return rows.groupBy("cluster", "i", "j").applyInArrow(tidied_groups(run), f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept. The bands are laid out for 80 percent or more."""
    if percent < 80:
        raise ValueError("percent must be 80 or more")
    sketch = stored(sketches(docs, k, id_column, text_column))
    known = sketch.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    classes = stored(known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")))
    cells = cells_of(classes)
    # an order of members that differs from cell to cell, so that a pair meets many leaders
    turn = F.struct(F.xxhash64("rep", "cell").alias("h"), F.col("rep").alias("id"))
    heads = cells.groupBy("cell").agg(F.min(turn).getField("id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = stored(cells.join(heads, "cell"))  # cells of several classes only
    couples = durable(members.where("rep != head").select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b")).distinct())
    near = durable(verify(couples, docs, k, percent, id_column, text_column))
    reclaim(docs.sparkSession)
    comp = connected_components(near.where("linked"))
    cluster = connected_components(near)
    name = lambda df, c: df.select(F.col("node").alias("rep"), F.col("component").alias(c))
    # all that resembles something, with its component
    state = durable(name(cluster, "cluster").join(name(comp, "comp"), "rep", "left").select("cluster", "rep", F.coalesce("comp", "rep").alias("comp")))
    mixed = state.groupBy("cluster").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("cluster")
    links = durable(within(durable(state.join(mixed, "cluster", "left_semi")), classes, docs, k, percent, id_column, text_column))
    apart = members.join(name(cluster, "comp"), "rep", "left").select("cell", "band", "rep", F.coalesce("comp", "rep").alias("comp"))
    several = apart.groupBy("cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("cell")
    apart = stored(apart.join(several, "cell", "left_semi"))
    pairs = durable(across(apart, classes).join(couples, ["a", "b"], "left_anti"))
    discard(apart)
    discard(members)
    reclaim(docs.sparkSession)
    links = links.union(verify(pairs, docs, k, percent, id_column, text_column).where("linked").select("a", "b"))
    side = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    more = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    above = connected_components(more).select(F.col("node").alias("part"), F.col("component").alias("whole"))
    named = classes.select("key", "rep").join(name(comp, "component"), "rep", "left").select("key", F.coalesce("component", "rep").alias("part"))
    named = named.join(above, "part", "left").select("key", F.coalesce("whole", "part").alias("component_id"))
    out = sketch.drop("sig").join(named, "key", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    out.stage_tables = [sketch, classes]  # to discard once the rows are kept elsewhere
    return out


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group. Only rows that a filter on ids picks out are shuffled; the rest pass through."""
    found = near_duplicates(docs, k, percent)
    tables, found = found.stage_tables, durable(found.select("doc_id", "kept"))
    for t in tables:
        discard(t)
    reclaim(docs.sparkSession)
    gone = found.where("NOT kept").select("doc_id").distinct()
    again = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    bloom = Bloom.build(gone.union(again).select(F.xxhash64("doc_id").alias("h")), "h")
    maybe = bloom.keep(docs, "doc_id")
    left = maybe.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return bloom.keep(docs, "doc_id", inside=False).unionByName(left).unionByName(maybe.where("doc_id IS NULL"))
