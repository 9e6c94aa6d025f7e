"""Toxicity by a subsequence string-kernel support vector machine.

Kernel: words are compared by the four-letter subsequences they share, with at
most one foreign letter between neighbours and a factor ``DECAY`` for each; a
word's two ends count as letters.  So ``idxiot`` and ``i-d-i-o-t`` stay close
to ``idiot`` (marks are dropped, inserted letters are gaps).  The value is
divided by the square root of the number of weighted placements in either word.

Learning: a labelled sample gives toxic and clean sentences.  A toxic document
has at least one toxic sentence and a sentence is as toxic as its worst word
(multiple-instance learning): words that set toxic documents apart are chosen
greedily, each from documents that the ones before leave unexplained; a
machine is trained on them against the words of clean sentences; the worst
words of toxic documents still unexplained join; this repeats.  Nyström: words
are mapped to their kernel values with at most ``LANDMARKS`` landmark words,
whitened by the landmarks' own kernel matrix, and the machine is linear there.

Scoring: a weighted sum of kernel values with fixed landmarks is a weighted
sum over subsequences, so the trained machine is folded into one table of
``2**BITS`` weights (hashed subsequences), 4 MB whatever the corpus.  Every
distinct word of a batch is scored once; a document's score is the logistic of
its worst word's value, fitted on the sample.

``SAMPLE`` bounds the labelled documents of each class that are learned from
(those with the smallest hash of ``doc_id``); every document is scored, whole.

Defined cases: null, empty and wordless texts get the score of a document
without a known word; without toxic or without clean labels every score is the
share of toxic labels (0 without any); a text in repeated rows gets the same
score in each; an empty table gives no rows.  Extra columns pass through
:func:`score`; the score is added as ``_tox_score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm.units import as_text, bounded_batches, code_points, slices, word_units

BITS = 20
DECAY = 0.6
LANDMARKS = 256
SAMPLE = 2000
ROUNDS = 3
THRESHOLD = 0.5
AT_ONCE = 1 << 15  # words scored at a time
MARGIN = 2.0  # values further from the boundary count as this far
GAPS = list(product((0, 1), repeat=3))
MIX = np.uint64(0x9E3779B97F4A7C15)


def placements(length: np.ndarray) -> np.ndarray:
    """Weighted placements of four letters in words of so many letters (ends included)."""
    total = np.zeros(len(length))
    for g in GAPS:
        total += DECAY ** (2 * sum(g)) * np.maximum(0, length - 3 - sum(g))
    return total


def subsequences(words: pa.Array):
    """For each gap pattern: (word index, hashed subsequence, weight)."""
    letters, n = code_points(words)
    ends = np.cumsum(n + 2)
    begins = ends - n - 2
    c = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    inner = np.ones(len(c), bool)
    inner[begins], inner[ends - 1] = False, False
    c[begins], c[ends - 1] = 1, 2
    c[inner] = letters
    word = np.repeat(np.arange(len(n)), n + 2)
    left = ends[word] - np.arange(len(c))  # letters from here to the word's end
    powers = [np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93)]
    for g in GAPS:
        o1, o2, o3 = 1 + g[0], 2 + g[0] + g[1], 3 + sum(g)
        at = np.flatnonzero(left > o3)
        h = c[at] * powers[0] + c[at + o1] * powers[1] + c[at + o2] * powers[2] + c[at + o3] * powers[3]
        h = (h ^ (h >> np.uint64(29))) * MIX
        yield word[at], (h >> np.uint64(64 - BITS)).astype(np.int64), DECAY ** sum(g)


def unit_scores(words: pa.Array, table: np.ndarray) -> np.ndarray:
    """The machine's value (without its constant) for each word."""
    total = np.zeros(len(words))
    for at in range(0, len(words), AT_ONCE):
        part = words.slice(at, AT_ONCE)
        own = total[at : at + AT_ONCE]
        for word, h, weight in subsequences(part):
            own += weight * np.bincount(word, table[h], len(part))
        size = placements(np.array([len(w) + 2 for w in part.to_pylist()]))
        own /= np.sqrt(np.maximum(size, 1e-9))
    return total


def features(words: pa.Array) -> list[dict[int, float]]:
    """Sparse normalised subsequence vectors, for the few words that are learned from."""
    out: list[dict[int, float]] = [{} for _ in range(len(words))]
    for word, h, weight in subsequences(words):
        for i, k in zip(word.tolist(), h.tolist(), strict=True):
            out[i][k] = out[i].get(k, 0.0) + weight
    size = np.sqrt(np.maximum(placements(np.array([len(w) + 2 for w in words.to_pylist()])), 1e-9))
    return [{k: v / s for k, v in x.items()} for x, s in zip(out, size, strict=True)]


def kernel(words: pa.Array, landmarks: list[dict[int, float]]) -> np.ndarray:
    out = np.empty((len(words), len(landmarks)))
    table = np.zeros(1 << BITS, np.float32)
    for j, z in enumerate(landmarks):
        at = np.fromiter(z, np.int64, len(z))
        table[at] = np.fromiter(z.values(), np.float32, len(z))
        out[:, j] = unit_scores_from(words, table)
        table[at] = 0
    return out


_last: tuple = (None, None, None)


def unit_scores_from(words: pa.Array, table: np.ndarray) -> np.ndarray:
    """As :func:`unit_scores`, keeping the words' subsequences between calls."""
    global _last
    if _last[0] is not words:
        size = np.sqrt(np.maximum(placements(np.array([len(w) + 2 for w in words.to_pylist()])), 1e-9))
        _last = (words, list(subsequences(words)), size)
    total = np.zeros(len(words))
    for word, h, weight in _last[1]:
        v = table[h]
        hit = np.flatnonzero(v)
        total += weight * np.bincount(word[hit], v[hit], len(words))
    return total / _last[2]


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Linear support vector machine with squared hinge loss, by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        active = y * (x @ beta) < 1
        xa, wa = x[active], weight[active]
        new = np.linalg.solve((xa * wa[:, None]).T @ xa + ridge * np.eye(x.shape[1]), (xa * wa[:, None]).T @ y[active])
        step = np.abs(new - beta).max()
        beta = new
        if step < 1e-7:
            break
    return beta


def witnesses(pair_doc: np.ndarray, pair_unit: np.ndarray, toxic: np.ndarray, clean_df: np.ndarray, n_clean: int) -> list[int]:
    """Words chosen greedily: each is common in unexplained toxic documents and rare in clean ones."""
    open_doc = toxic.copy()
    chosen: list[int] = []
    banned = np.zeros(len(clean_df), bool)
    while len(chosen) < LANDMARKS // 2:
        live = open_doc[pair_doc]
        df = np.bincount(pair_unit[live], minlength=len(clean_df))
        lift = (df / max(1, open_doc.sum())) / ((clean_df + 0.5) / (n_clean + 1))
        gain = np.where((df >= 3) & (lift > 20) & ~banned, df, 0)
        best = int(gain.argmax())
        if gain[best] == 0:
            break
        chosen.append(best)
        banned[best] = True
        open_doc[pair_doc[pair_unit == best]] = False
    # words that the ones chosen before always came with
    df = np.bincount(pair_unit[toxic[pair_doc]], minlength=len(clean_df))
    lift = (df / max(1, toxic.sum())) / ((clean_df + 0.5) / (n_clean + 1))
    sure = np.flatnonzero((df >= max(8, 0.02 * toxic.sum())) & (lift > 20) & ~banned)
    return chosen + sure[np.argsort(-df[sure], kind="stable")].tolist()


def disguised(word: str) -> list[str]:
    """A word with a letter doubled and with a foreign letter put in."""
    mid = len(word) // 2
    return [word[:mid] + word[mid - 1] + word[mid:], word[:mid] + "x" + word[mid:]] if len(word) >= 5 else []


def distinct_units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(units, document, unit): the distinct units of each text."""
    found, docs, names = [], [], []
    for at, n in slices(texts):
        units, unit, doc = word_units(texts.slice(at, n))
        pairs = np.unique(doc.astype(np.int64) * len(units) + unit)
        names.append(units)
        docs.append(at + pairs // len(units))
        found.append(pairs % len(units))
    coded = pa.concat_arrays(names).dictionary_encode()
    begin = np.cumsum([0, *map(len, names)])
    code = coded.indices.to_numpy().astype(np.int64)
    return coded.dictionary, np.concatenate(docs), np.concatenate([code[b + f] for b, f in zip(begin, found, strict=False)])


def probability(worst: np.ndarray, model) -> np.ndarray:
    """Scores of documents from the largest :func:`unit_scores` of each (-inf: no words)."""
    _, bias, slope, constant = model
    margin = np.clip(np.where(np.isfinite(worst), worst, 0.0) + bias, -MARGIN, MARGIN)
    return 1 / (1 + np.exp(-np.clip(slope * margin + constant, -30, 30)))


def train(texts: list[str], toxic: list[int], share: float | None = None) -> tuple[np.ndarray, float, float, float]:
    """(weights of subsequences, bias, slope, constant), as :func:`probability` uses them.

    ``share``: the share of toxic documents among all labels, for the constant.
    """
    y = np.array(toxic, bool)
    none = np.zeros(1 << BITS, np.float32)
    if share is None:
        share = float(y.mean()) if len(y) else 0.0
    if len(y) == 0 or y.all() or not y.any():
        p = min(max(share if len(y) else 0.0, 1e-6), 1 - 1e-6)
        return none, 0.0, 0.0, float(np.log(p / (1 - p)))
    units, pair_doc, pair_unit = distinct_units(pa.array(texts, pa.string()))
    clean_df = np.bincount(pair_unit[~y[pair_doc]], minlength=len(units))
    positive = witnesses(pair_doc, pair_unit, y, clean_df, int((~y).sum()))
    if not positive:
        return none, 0.0, 0.0, float(np.log(share / (1 - share)))
    clean = np.setdiff1d(np.flatnonzero(clean_df), positive)
    order = np.random.default_rng(7).permutation(len(clean))
    negative = clean[order[:4000]]
    table, worst_clean = none, negative[:0]
    for _ in range(ROUNDS):
        if table is not none:  # the clean words that look worst
            worst_clean = clean[np.argsort(-unit_scores(units.take(pa.array(clean)), table))[:2000]]
            negative = np.union1d(negative, worst_clean)
        few = [*positive[: LANDMARKS // 2], *worst_clean[: LANDMARKS // 4]]
        few += [*negative[np.linspace(0, len(negative) - 1, min(len(negative), LANDMARKS // 4)).astype(int)]]
        few = list(dict.fromkeys(few))
        marks = features(units.take(pa.array(few)))
        k = kernel(units.take(pa.array(few)), marks)
        values, vectors = np.linalg.eigh(k)
        keep = values > 1e-6 * values.max()
        white = vectors[:, keep] / np.sqrt(values[keep])
        bad = units.take(pa.array(positive)).to_pylist()
        bad += [v for w in bad for v in disguised(w)]
        words = pa.concat_arrays([pa.array(bad, units.type), units.take(pa.array(negative))])
        sign = np.where(np.arange(len(words)) < len(bad), 1.0, -1.0)
        x = np.hstack([kernel(words, marks) @ white, np.ones((len(words), 1))])
        # a clean word costs as much as the clean documents that have it, up to 20
        weight = np.concatenate([np.full(len(bad), 4.0), np.minimum(clean_df[negative], 20.0)])
        beta = squared_hinge(x, sign, weight)
        alpha = white @ beta[:-1]
        table = np.zeros(1 << BITS, np.float32)
        for a, z in zip(alpha, marks, strict=True):
            at = np.fromiter(z, np.int64, len(z))
            table[at] += a * np.fromiter(z.values(), np.float64, len(z))
        value = unit_scores(units, table) + beta[-1]
        worst = np.full(len(y), -np.inf)
        np.maximum.at(worst, pair_doc, value[pair_unit])
        known = np.isin(pair_unit, positive)
        explained = np.zeros(len(y), bool)
        explained[pair_doc[known]] = True
        more = np.flatnonzero((value[pair_unit] > 0) & (clean_df[pair_unit] == 0) & y[pair_doc] & ~explained[pair_doc])
        positive = list(dict.fromkeys([*positive, *pair_unit[more].tolist()]))
    worst = np.where(np.isfinite(worst), worst, beta[-1])
    slope, constant = logistic(np.clip(worst, -MARGIN, MARGIN), y)
    have = y.mean()
    share = min(max(share, 1e-6), 1 - 1e-6)
    shift = np.log(share / (1 - share)) - np.log(have / (1 - have))
    return table, float(beta[-1]), slope, float(constant + shift)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and constant of a one-dimensional logistic fit, slightly smoothed."""
    a, b = 1.0, 0.0
    t = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - t) * x).sum() + 1e-3 * a, (p - t).sum()])
        v = p * (1 - p)
        h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-9]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-9:
            break
    return float(a), float(b)


def sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, most: int):
    """(texts, labels, share of label 1): at most ``most`` labelled documents of each class outside the held-out fold."""
    fold = F.crc32(F.col("doc_id").cast("string")) % modulus
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold != held))
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    n = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}  # two rows
    few = [rows.where(F.col("_label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for v in (0, 1)]
    chosen = few[0].union(few[1])  # at most 2 * most ids
    got = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    got = got.groupBy("doc_id", "_label").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    return [r["text"] for r in got], [r["_label"] for r in got], (n.get(1, 0) / sum(n.values()) if n else 0.0)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = SAMPLE):
    bounded_batches(spark)
    texts, toxic, share = sample(spark, docs, labels, "toxic", 5, 0, most)
    return train(texts, toxic, share)


def score(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """``docs`` with ``_tox_score``, the probability that its text is toxic; only the texts go through Python."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            texts, found = as_text(column), np.empty(len(column))
            for at, n in slices(texts):
                units, unit, doc = word_units(texts.slice(at, n))
                worst = np.full(n, -np.inf)
                np.maximum.at(worst, doc, unit_scores(units, model[0])[unit])
                found[at : at + n] = probability(worst, model)
            yield pa.array(found)

    return docs.withColumn("_tox_score", F.arrow_udf(run, "double")(F.col(text)))


def op8_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all ``documents``; labels of the held-out fold are not learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"),
        F.col("_tox_score").alias("score"),
        (F.col("_tox_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the model does not call toxic."""
    model = fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).where(F.col("_tox_score") < THRESHOLD).select(*docs.columns)
