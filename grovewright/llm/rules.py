"""Quality rules: a learned decision list over statistics of whole texts.

Sequential covering on labelled statistics: a rule is a conjunction of thresholds, grown
by information gain on one part of the examples and pruned on the other; rows that it
covers leave, and the next rule is learned. The ordered list becomes one Spark
conditional expression, so verdicts are given in the JVM and can be read by people.

Null text has no words, so base_failed holds. Repeated rows get a row each. Without
labelled rows of both kinds the list is empty and only the base rules reject. Extra
columns are ignored; labels that contradict each other count by their mean.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHash, durable, fold, ngrams, part_of, raw, tidied

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
NOT_A_START = SPACE + bytes(range(0x80, 0xC0))
CAPITALS = bytes(range(65, 91))
MARKS = b"!?.,;:"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks", "n_distinct"]
#: Statistic -> expression over the counts; these are what rules may test.
STATISTICS = {
    "words": "n_words * 1.0D",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "capitals_per_char": "n_capitals / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
}
#: Labelled rows that the list is learned from, about.
FIT_ROWS = 20_000


def counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id and COUNTS."""
    kind = docs.schema[id_column].dataType.simpleString()

    def one(text: bytes, hashed: WordHash) -> tuple:
        words = text.split()
        n = len(words)
        lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
        repeat, distinct = 0, n
        if n:
            h = hashed.of(words)
            distinct = len(np.unique(h))
        if n >= 3:
            _, where, times = np.unique(ngrams(h, 3), return_inverse=True, return_counts=True)
            again = times[where] > 1
            covered = np.zeros(n, bool)
            for j in range(3):
                covered[j : n - 2 + j] |= again
            repeat = int(covered.sum())
        left = lambda drop: len(text) - len(text.translate(None, drop))
        return n, len(text) - left(NOT_A_START), left(SYMBOLS), len(lines) - len(set(lines)), repeat, len(lines), left(CAPITALS), left(MARKS), distinct

    def run(batches):
        hashed = WordHash()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = [one(t or b"", hashed) for t in raw(part.column(1))]
                cols = list(zip(*rows)) if rows else [()] * len(COUNTS)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in cols]], names=["doc_id", *COUNTS])

    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(tidied(run), schema)


@dataclass
class Rule:
    """Rejects where all (statistic, is at least, threshold) hold."""

    tests: list[tuple[str, bool, float]]
    precision: float

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, at in self.tests:
            out = out & ((F.expr(STATISTICS[name]) >= at) if above else (F.expr(STATISTICS[name]) < at))
        return out


def covers(tests, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for name, above, at in tests:
        out &= (x[name] >= at) if above else (x[name] < at)
    return out


def grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int = 4) -> list:
    """Add the test of the highest information gain until only bad rows are covered."""
    tests, inside = [], np.ones(len(bad), bool)
    for _ in range(most):
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        if not n or not p:
            break
        before, best = np.log2(p / (p + n)), (0.0, None)
        for name, values in x.items():
            v, y = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            below = np.cumsum(y)
            cut = np.flatnonzero(v[1:] > v[:-1])  # between these rows a threshold may lie
            if not len(cut):
                continue
            size = cut + 1
            for above in (False, True):
                pos = p - below[cut] if above else below[cut]
                all_ = (p + n - size) if above else size
                gain = np.where(pos > 0, pos * (np.log2(np.maximum(pos, 1e-9) / all_) - before), 0)
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), (name, above, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
        if best[1] is None:
            break
        tests.append(best[1])
        inside &= covers([best[1]], x)
    return tests


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most: int = 12, purity: float = 0.9) -> list[Rule]:
    """Sequential covering; every third row is for pruning."""
    rules, left = [], np.ones(len(bad), bool)
    for _ in range(most):
        prune = np.arange(len(bad)) % 3 == 2
        part = lambda m: ({k: v[m] for k, v in x.items()}, bad[m])
        if bad[left].sum() < 5:
            break
        tests = grow(*part(left & ~prune))
        if not tests:
            break
        px, py = part(left & prune)

        def worth(t):
            c = covers(t, px)
            return (py[c].sum() - (~py[c]).sum()) / max(1, c.sum())

        tests = max((tests[:k] for k in range(len(tests), 0, -1)), key=worth)
        c = covers(tests, x) & left
        share = bad[c].mean() if c.any() else 0.0
        if share < purity:
            break
        rules.append(Rule(tests, float(share)))
        left &= ~c
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: true keeps."""
    out = None
    for r in rules:
        out = F.when(r.column(), False) if out is None else out.when(r.column(), False)
    return F.lit(True) if out is None else out.otherwise(True)


def fit(counted: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[Rule]:
    """Learn from about `rows` labelled rows outside fold 0 of 5, taken by hash of the id."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 5) != 0)).groupBy("doc_id").agg((F.avg("quality") < 0.5).alias("bad"))
    sample = marks.where(part_of("doc_id", rows, marks.count()))
    got = counted.join(F.broadcast(sample), "doc_id").select("bad", *[F.expr(e).alias(k) for k, e in STATISTICS.items()]).toPandas()
    got = got.sort_values(list(STATISTICS), ignore_index=True).sample(frac=1, random_state=1)
    if not len(got) or got["bad"].nunique() < 2:
        return []
    return learn({k: got[k].to_numpy(float) for k in STATISTICS}, got["bad"].to_numpy(bool))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, COUNTS, base_failed, kept, rule (the number of the rule that rejects, else null)."""
    counted = durable(counts(docs))
    rules = fit(counted, labels)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    number = F.coalesce(*[F.when(r.column(), F.lit(i)) for i, r in enumerate(rules)], F.lit(None).cast("int"))
    return counted.withColumns({"base_failed": failed, "kept": ~failed & verdict(rules), "rule": number})
