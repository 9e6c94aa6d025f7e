"""Benchmark decontamination by latent semantic retrieval.

Words are compared in lower case without marks.  A benchmark item is cut into
passages of at most ``PASSAGE`` words; its vector has ``sqrt(count) * weight``
for each word, where a word's weight is the logarithm of how rare its hash
bucket is among all words of all documents.  A randomised singular value
decomposition of the passage matrix gives the latent space: each multiplication
by the matrix and its transpose is a job over the passages, only matrices of
``RANK`` columns meet on the driver.

Every document is read in overlapping windows of a width for each class of
passage lengths: a class of at most ``c`` words (``SIZES``) has windows of
``3 * c + SPREAD`` words, one every ``c``, so a copy that is spread over up to
``2 * c + SPREAD`` words lies in one of them as a whole.  A window that passes
the check below holds ``HELD`` of the passage's weight, and so many of its words
that their weight is at least that of as many of the lightest; no bound on
candidates asks for more than this ``need``.  A passage's head is its heaviest
words, without which less than half of its need is left; an inverted index of
heads rules out nearly all pairs.  The rest are folded into the latent space: their product there, and at
most the product of what the space leaves out of both, is what the window holds
of the passage, so no rank and no number of passages loses a pair.

A candidate is a leak if the longest common subsequence of the passage's words
and the window's has ``COPIED`` of the passage's words, or
``REWORDED`` of them and, in the right order, ``ANSWERED`` of the item's last
sentence (its answer), and if the window's words hold ``HELD`` of the passage's
weight (the squared length of its vector), as frequent words alone are no copy.
Changed, added and moved words lower these shares gradually.

The benchmark is searched in blocks of at most ``BLOCK`` passages, one pass
over the documents each; a block is what tasks receive (at most ``BLOCK *
RANK`` floats and as many passages of ``PASSAGE`` words).

Defined cases: null and empty texts hold no leak; items without words or with
fewer than ``LEAST`` words are not searched for (they are not distinctive);
an item with several texts is searched for by each and gives one result, and so do
repeated rows; items without an id are searched for and give one result without an id;
repeated documents each give theirs; empty tables give no rows.  Extra columns are not read, and are kept by
:func:`clean`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm.units import as_text, bounded_batches, parts, slices, string_hash

TERM_BITS = 18  # hash buckets of words whose frequencies are counted
TERMS = 1 << 15  # hashed terms of the passage matrix
RANK = 256
PASSAGE = 64
SIZES = np.array([8, 12, 16, 24, 32, 48, PASSAGE])  # classes of passage lengths
SPREAD = 16
HELD = 0.25
ROUNDING = 1e-3  # share of both lengths that rounding may take from a product
COPIED, REWORDED, ANSWERED = 0.6, 0.5, 0.9
LEAST = 5
BLOCK = 4096
LEAK = "doc_id long, item_id long, cosine double, shared double, answered boolean, at_word long"


def clean_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, ends): every text's words in order, without marks and case."""
    words = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy())
    coded = words.flatten().dictionary_encode()
    clean = pc.replace_substring_regex(coded.dictionary, r"[^\p{L}\p{M}\p{N}]", "")
    codes = coded.indices.to_numpy()
    full = (pc.binary_length(clean).to_numpy() > 0)[codes]
    return string_hash(clean)[codes[full]], np.cumsum(np.bincount(doc[full], minlength=len(texts)))


def bucket(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def word_weights(docs: DataFrame) -> np.ndarray:
    """The weight of each bucket of words, from the words of all documents."""

    def count(batches):
        total = np.zeros(1 << TERM_BITS, np.int64)
        for _, texts in parts(batches, "text"):
            total += np.bincount(bucket(clean_words(texts)[0]), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["b", "n"])

    counts = np.zeros(1 << TERM_BITS)
    found = docs.select("text").mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column("b").to_numpy()] = found.column("n").to_numpy()  # at most a row per bucket
    return np.log((counts.sum() + len(counts)) / (counts + 1)).astype(np.float32)


def split_item(text: str) -> list[str]:
    """Passages of at most ``PASSAGE`` words."""
    words = text.split()
    pieces = max(1, -(-len(words) // PASSAGE))
    size = -(-len(words) // pieces) if words else 0
    return [" ".join(words[i : i + size]) for i in range(0, len(words), size)] if words else []


def last_sentence(text: str) -> str:
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n", text.strip()) if s.split()]
    return sentences[-1] if sentences else ""


def passages(benchmark: DataFrame) -> DataFrame:
    """(item_id, part, text, answer): the passages of all items."""

    def cut(batches):
        for batch in batches:
            rows = [
                (i, k, p, last_sentence(t))
                for i, t in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
                for k, p in enumerate(split_item(t))
            ]
            yield pa.RecordBatch.from_pylist([dict(zip(("item_id", "part", "text", "answer"), r, strict=True)) for r in rows], schema)

    schema = pa.schema([("item_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("answer", pa.string())])
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    return items.mapInArrow(cut, "item_id long, part long, text string, answer string")


def vectors(words: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, value) of the weighted word counts of each text, rows scaled to length 1."""
    row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    pair, first, n = np.unique(row * np.int64(TERMS) + (words % np.uint64(TERMS)).astype(np.int64), return_index=True, return_counts=True)
    value = np.sqrt(n) * weights[bucket(words[first])]
    row, term = pair // TERMS, pair % TERMS
    norm = np.sqrt(np.bincount(row, value**2, len(ends)))
    return row, term, value / np.maximum(norm[row], 1e-12)


def random_columns(k: int) -> np.ndarray:
    return np.random.default_rng(5).standard_normal((TERMS, k), dtype=np.float32)


def gram_times(table: DataFrame, weights: np.ndarray, q: np.ndarray | None, terms: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(terms, (A' A) q) for the passage matrix A, as a job over the passages; q None: random columns.

    Only terms that a passage holds have rows, here and in ``q``: the others are zero.
    """

    def part(batches):
        own, total = (random_columns(k) if q is None else q), {}
        for _, texts in parts(batches, "text"):
            row, term, value = vectors(*clean_words(texts), weights)
            at = term if q is None else np.searchsorted(terms, term)
            y = np.zeros((len(texts), k), np.float32)
            np.add.at(y, row, own[at] * value[:, None].astype(np.float32))
            for t in np.unique(term).tolist():
                here = term == t
                total[t] = total.get(t, 0) + value[here].astype(np.float32) @ y[row[here]]
        for t, v in total.items():
            yield pa.record_batch([pa.array([t]), pa.array([v], pa.list_(pa.float32()))], ["t", "v"])

    def add(batches):
        total = {}
        for batch in batches:
            values = batch.column("v").values.to_numpy().reshape(-1, k)
            for t, v in zip(batch.column("t").to_pylist(), values, strict=True):
                total[t] = total.get(t, 0) + v
        for t, v in total.items():
            yield pa.record_batch([pa.array([t]), pa.array([v], pa.list_(pa.float32()))], ["t", "v"])

    schema = "t long, v array<float>"
    # every task has summed its passages; a term's sums meet in one task
    sums = table.select("text").mapInArrow(part, schema).repartition("t").mapInArrow(add, schema).toArrow().combine_chunks()
    found = sums.column("t").to_numpy()
    order = np.argsort(found)
    out = np.empty((len(found), k), np.float32)
    for at, v in zip(np.argsort(order).tolist(), sums.column("v"), strict=True):
        out[at] = v.values.to_numpy()
    return found[order], out


def latent_space(table: DataFrame, weights: np.ndarray, n: int) -> np.ndarray:
    """Right singular vectors (terms by rank) of the passage matrix."""
    k = max(1, min(RANK, n))
    terms = q = None
    for _ in range(2):
        terms, product = gram_times(table, weights, q, terms, k)
        # more columns than terms: as many rows of zeros, as the terms without a passage have
        q = np.linalg.qr(np.vstack([product, np.zeros((max(0, k - len(product)), k), np.float32)]))[0][: len(product)]
    small = q.T @ gram_times(table, weights, q, terms, k)[1]
    values, u = np.linalg.eigh((small + small.T) / 2)
    rows = q @ u[:, values > 1e-6 * max(values.max(), 1e-12)][:, ::-1]
    space = np.zeros((TERMS, rows.shape[1]), np.float32)
    space[terms] = rows
    return space


class Block:
    """Passages to search for, ready for a task."""

    def __init__(self, rows, space: np.ndarray, weights: np.ndarray):
        texts = pa.array([r["text"] for r in rows], pa.string())
        words, ends = clean_words(texts)
        begin = ends - np.diff(ends, prepend=0)
        keep = [i for i in range(len(rows)) if ends[i] - begin[i] >= LEAST]
        self.items = [rows[i]["item_id"] for i in keep]
        self.words = [words[begin[i] : ends[i]] for i in keep]
        answers, a_ends = clean_words(pa.array([rows[i]["answer"] for i in keep], pa.string()))
        self.answers = np.split(answers, a_ends[:-1]) if keep else []
        # only the rows of terms that a passage holds are handed to tasks
        full = np.flatnonzero(space.any(1))
        self.rows, self.row = np.ascontiguousarray(space[full]), np.full(len(space), -1, np.int32)
        self.row[full] = np.arange(len(full))
        self.weights = weights
        self.size = SIZES[np.searchsorted(SIZES, [len(own) for own in self.words])]
        self.need, self.head_need = np.zeros(len(keep)), np.zeros(len(keep))
        self.latent = np.zeros((len(keep), space.shape[1]), np.float32)
        self.outside = np.zeros(len(keep))
        self.norm = np.zeros(len(keep))
        # the heads as an inverted index: words in order, where each one's list begins, passage and value
        heads = []
        for p, own in enumerate(self.words):
            energy = np.sort(weights[bucket(own)].astype(np.float64) ** 2)
            self.need[p] = max(HELD * energy.sum(), energy[: least_shared(len(own), len(self.answers[p]))].sum())
            self.latent[p], self.norm[p], self.outside[p] = folded(own, self.rows, self.row, weights)
            name, count = np.unique(own, return_counts=True)
            value = np.sqrt(count) * weights[bucket(name)].astype(np.float64)
            order = np.argsort(weights[bucket(name)], kind="stable")
            left = np.cumsum(value[order] ** 2)
            tail = int((left < self.need[p] / 2).sum())
            self.head_need[p] = self.need[p] - (left[tail - 1] if tail else 0.0)
            heads += [(int(w), p, float(v)) for w, v in zip(name[order[tail:]], value[order[tail:]], strict=True)]
        heads.sort()
        words_ = np.array([w for w, _, _ in heads], np.uint64)
        self.vocabulary, begin = np.unique(words_, return_index=True)
        self.begin = np.append(begin, len(words_))
        self.passage = np.array([p for _, p, _ in heads], np.int64)
        self.value = np.array([v for _, _, v in heads])


def least_shared(n: int, answer: int) -> int:
    """The fewest words in common with which a passage of ``n`` words can be a leak."""
    share = REWORDED if 0 < answer < n else COPIED
    return next(m for m in range(n + 1) if m / n >= share)


def folded(words: np.ndarray, rows: np.ndarray, row: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(latent vector, length, length of what the space leaves out) of the weighted word counts.

    ``row``: where each term's row of the space is in ``rows``, -1 for a row of zeros.
    """
    words = np.sort(words)
    new = np.empty(len(words), bool)
    new[:1] = True
    np.not_equal(words[1:], words[:-1], out=new[1:])
    own, upto = words[new], np.flatnonzero(new)
    count = np.empty(len(upto), np.int64)
    np.subtract(upto[1:], upto[:-1], out=count[:-1])
    count[-1:] = len(words) - upto[-1:]
    value = np.sqrt(count) * weights[bucket(own)]
    term = (own % np.uint64(TERMS)).astype(np.int64)
    ordered = np.sort(term)
    if (ordered[1:] == ordered[:-1]).any():  # words that share a term
        term, at = np.unique(term, return_inverse=True)
        value = np.bincount(at, value)
    value = value.astype(np.float32)
    place = row[term]
    held_ = place >= 0
    x = value[held_] @ rows[place[held_]]
    square = float(value @ value)
    return x, square**0.5, max(0.0, square - float(x @ x)) ** 0.5


def common(passage: np.ndarray, region: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit per word of the passage."""
    at: dict[int, int] = {}
    for i, w in enumerate(passage.tolist()):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(passage)) - 1
    state = full
    for places in [at[w] for w in region.tolist() if w in at]:
        hit = state & places
        if hit:
            state = (state + hit | state - hit) & full
    return len(passage) - state.bit_count()


def held(passage: np.ndarray, region: np.ndarray, weights: np.ndarray) -> float:
    """The share of the passage's weight in words that the region holds, as often as it holds them."""
    name, count = np.unique(passage, return_counts=True)
    other, n = np.unique(region, return_counts=True)
    at = np.minimum(np.searchsorted(other, name), len(other) - 1)
    energy = weights[bucket(name)].astype(np.float64) ** 2
    return float((np.minimum(count, np.where(other[at] == name, n[at], 0)) * energy).sum() / max((count * energy).sum(), 1e-12))


def likely(words: np.ndarray, n: np.ndarray, block: Block):
    """(document, first word, end, passage) of windows that may hold what a leak of the passage needs, by window."""
    ends = np.cumsum(n)
    begin = ends - n
    place = np.minimum(np.searchsorted(block.vocabulary, words), len(block.vocabulary) - 1)
    at = np.flatnonzero(block.vocabulary[place] == words)
    many = (block.begin[1:] - block.begin[:-1])[place[at]]
    entry = np.repeat(block.begin[place[at]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    at = np.repeat(at, many)
    doc = np.searchsorted(ends, at, "right")
    passage = block.passage[entry]
    part = block.weights[bucket(words[at])] * block.value[entry]
    out = []
    for size in np.unique(block.size).tolist():
        width = 3 * size + SPREAD
        windows = np.maximum(1, -(-(n - width) // size) + 1) * (n > 0)
        base = np.cumsum(windows) - windows
        here = np.flatnonzero(block.size[passage] == size)
        d, word = doc[here], at[here] - begin[doc[here]]
        key, value = [], []
        for back in range(-(-width // size)):
            k = word // size - back
            good = (k >= 0) & (k < windows[d]) & (word - k * size < width)
            key.append((base[d[good]] + k[good]) * len(block.items) + passage[here[good]])
            value.append(part[here[good]])
        key, where = np.unique(np.concatenate(key), return_inverse=True)
        value = np.bincount(where, np.concatenate(value), len(key))
        key = key[value >= block.head_need[key % len(block.items)] * (1 - ROUNDING)]
        window, p = key // len(block.items), key % len(block.items)
        d = np.searchsorted(base + windows, window, "right")
        first = begin[d] + (window - base[d]) * size
        out.append((d, first, np.minimum(first + width, ends[d]), p))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def search(texts: pa.Array, block: Block) -> list[tuple]:
    """(row, item, cosine, shared, answered, word) of the leaks in the texts, the best of each row and item."""
    words, ends = clean_words(texts)
    if len(words) == 0 or len(block.vocabulary) == 0:
        return []
    n = np.diff(ends, prepend=0)
    begin = ends - n
    found: dict[tuple, tuple] = {}
    doc, first, end, pair = likely(words, n, block)
    if len(doc) == 0:
        return []
    cuts = np.flatnonzero(np.diff(first, prepend=-1) | np.diff(end, prepend=-1))
    for at, to in zip(cuts.tolist(), np.append(cuts[1:], len(first)).tolist(), strict=True):
        r, i, j, near = int(doc[at]), int(first[at]), int(end[at]), pair[at:to]
        x, norm, outside = folded(words[i:j], block.rows, block.row, block.weights)
        product = block.latent[near] @ x
        most = product + outside * block.outside[near] + ROUNDING * norm * block.norm[near]
        for p, dot in zip(near[most >= block.need[near]].tolist(), product[most >= block.need[near]].tolist(), strict=True):
            passage, answer = block.words[p], block.answers[p]
            shared = common(passage, words[i:j]) / len(passage)
            if shared < min(COPIED, REWORDED) or held(passage, words[i:j], block.weights) < HELD * (1 - ROUNDING):
                continue
            answered = len(answer) > 0 and common(answer, words[i:j]) >= ANSWERED * len(answer)
            if shared >= COPIED or (shared >= REWORDED and answered and len(answer) < len(passage)):
                cosine = dot / max(norm * float(np.linalg.norm(block.latent[p])), 1e-12)
                key, best = (r, block.items[p]), (shared, cosine, bool(answered), i - int(begin[r]))
                if best[:2] > found.get(key, (0, 0))[:2]:
                    found[key] = best
    return [(r, item, c, s, ans, at) for (r, item), (s, c, ans, at) in sorted(found.items(), key=lambda f: (f[0][0], f[0][1] is None, f[0][1] or 0))]


def blocks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame):
    """The benchmark as :class:`Block` s of bounded size."""
    bounded_batches(spark)
    table = passages(benchmark)
    n = table.count()
    if n == 0:
        return
    weights = word_weights(docs)
    space = latent_space(table, weights, n)
    parts_ = -(-n // BLOCK)
    for k in range(parts_):
        own = table.where(F.pmod(F.xxhash64("item_id", "part", "text"), F.lit(parts_)) == k) if parts_ > 1 else table
        yield Block(own.orderBy("item_id", "part", "text").collect(), space, weights)


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document and benchmark item that it holds."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("shared", pa.float64()), ("answered", pa.bool_()), ("at_word", pa.int64())])

    def leaks_with(block: Block):
        def run(batches):
            for batch, texts in parts(batches, "text"):
                if rows := search(texts, block):
                    ids = batch.column("doc_id").to_pylist()
                    yield pa.record_batch([pa.array(c) for c in zip(*[(ids[r], *rest) for r, *rest in rows], strict=True)], schema=schema)

        return run

    out = spark.createDataFrame([], LEAK)
    for block in blocks(spark, docs, benchmark):
        out = out.union(docs.mapInArrow(leaks_with(block), LEAK))
    best = F.max_by(F.struct("cosine", "shared", "answered", "at_word"), F.struct("shared", "cosine")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak; only the texts go through Python."""

    def kept_by(block: Block):
        def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in columns:
                texts, keep = as_text(column), np.ones(len(column), bool)
                for at, n in slices(texts):
                    keep[[at + r for r, *_ in search(texts.slice(at, n), block)]] = False
                yield pa.array(keep)

        return F.arrow_udf(run, "boolean")

    out = docs
    for block in blocks(spark, docs, benchmark):
        out = out.where(kept_by(block)(F.col("text")))
    return out


def op7_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of all ``documents`` hold which ``benchmark`` items."""
    return find_leaks(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold no benchmark item."""
    return clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
