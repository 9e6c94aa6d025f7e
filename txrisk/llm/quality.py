"""Text quality by nearest-neighbour voting in a latent-semantic space.

Terms of a text: its words (hashed), the shapes of its words (letters and
digits collapsed, marks kept), and binned proportions (repeated neighbours,
distinct words, repeated lines, capitals, marks, length).  A text is its
``log(1 + count) * idf`` vector, where document frequencies are counted over
every document; words and layout are normalised apart, as there are far more
words.  A randomised singular value decomposition of labelled vectors gives
``RANK`` latent dimensions.

The labelled vectors (at most ``SAMPLE`` of each class: 2 * 2000 * 48 floats,
0.8 MB, whatever the corpus) go to every task; each block of documents is
multiplied with all of them, and the ``NEIGHBOURS`` most similar vote with
their cosine to the power ``SHARPNESS``, classes weighted to their share among
all labels.

Defined cases: null and empty texts are texts without words (they have binned
terms of their own); without labels every score is 0.5, with one class it is
that class; equal cosines are taken in ``doc_id`` order of the labelled rows;
repeated rows score alike; an empty table gives no rows.  Extra columns pass
through :func:`score`; the score is added as ``_quality_score``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.llm.toxicity import sample
from txrisk.llm.units import bounded_batches, parts, slices, string_hash

WORDS, LAYOUT = 1 << 14, 1 << 12  # hashed terms of either kind
RANK = 48
SAMPLE = 2000
NEIGHBOURS = 25
SHARPNESS = 4
WORD_WEIGHT = 0.35
THRESHOLD = 0.7
BLOCK = 1024
PAIRS = 1 << 17  # (document, term) pairs multiplied at a time


def _bins(doc: np.ndarray, hit: np.ndarray, n_docs: int, total: np.ndarray) -> np.ndarray:
    share = np.bincount(doc[hit], minlength=n_docs) / np.maximum(total, 1)
    return np.where(total == 0, 11, np.ceil(share * 10)).astype(np.int64)


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of texts; terms below ``WORDS`` are words, the rest layout."""
    n = len(texts)
    lists = pc.utf8_split_whitespace(texts)
    doc = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy())
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    codes, distinct = coded.indices.to_numpy(), coded.dictionary
    keep = (pc.binary_length(distinct).to_numpy() > 0)[codes]
    codes, doc = codes[keep], doc[keep]
    total = np.bincount(doc, minlength=n)
    lower = pc.utf8_lower(distinct)
    shape = pc.replace_substring_regex(pc.replace_substring_regex(distinct, r"[\p{Ll}\p{Lo}\p{M}]+", "a"), r"\p{Lu}+", "A")
    shape = pc.replace_substring_regex(shape, r"\p{N}+", "0")
    word = (string_hash(lower) % np.uint64(WORDS)).astype(np.int64)[codes]
    form = WORDS + 128 + (string_hash(shape) % np.uint64(LAYOUT - 128)).astype(np.int64)[codes]
    capital = pc.match_substring_regex(distinct, r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$").to_numpy(zero_copy_only=False)[codes]
    marked = pc.match_substring_regex(distinct, r"[^\p{L}\p{M}\p{N}.,'\-]").to_numpy(zero_copy_only=False)[codes]
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    first = np.zeros(len(codes), bool)
    first[np.unique(doc * np.int64(len(distinct) + 1) + codes, return_index=True)[1]] = True
    lines = pc.split_pattern(texts, "\n")
    line_doc = np.repeat(np.arange(n), pc.list_value_length(lines).to_numpy())
    line = lines.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    new_line = np.zeros(len(line), bool)
    if len(line):
        new_line[np.unique(line_doc * (int(line.max()) + 1) + line, return_index=True)[1]] = True
    old = _bins(line_doc, ~new_line, n, np.bincount(line_doc, minlength=n))
    binned = [_bins(doc, x, n, total) for x in (again, first, capital, marked)] + [old]
    binned.append(np.minimum(11, np.log2(total + 1)).astype(np.int64))
    rows = np.arange(n)
    all_doc = np.concatenate([doc, doc, *[rows] * len(binned)])
    all_term = np.concatenate([word, form, *[WORDS + 12 * k + b for k, b in enumerate(binned)]])
    pair, count = np.unique(all_doc * np.int64(WORDS + LAYOUT) + all_term, return_counts=True)
    return pair // (WORDS + LAYOUT), pair % (WORDS + LAYOUT), count


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """Documents that have each term, and the number of documents, over all rows."""

    def count(batches):
        df, n = np.zeros(WORDS + LAYOUT + 1, np.int64), 0
        for batch, texts in parts(batches, text):
            df[:-1] += np.bincount(terms(texts)[1], minlength=WORDS + LAYOUT)
            n += batch.num_rows
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(at), pa.array(df[at])], ["term", "df"])

    rows = docs.select(text).mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(WORDS + LAYOUT + 1, np.int64)  # at most as many rows as terms
    df[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    return df[:-1], int(df[-1])


def weigh(doc: np.ndarray, term: np.ndarray, count: np.ndarray, n: int, idf: np.ndarray) -> np.ndarray:
    """Weights of the (document, term) pairs, either kind of term normalised by document."""
    value = np.log1p(count) * idf[term]
    for kind, part in ((term < WORDS, WORD_WEIGHT), (term >= WORDS, 1.0)):
        norm = np.sqrt(np.bincount(doc[kind], value[kind] ** 2, n))
        value[kind] *= part / np.maximum(norm[doc[kind]], 1e-12)
    return value


def project(doc, term, value, n: int, basis: np.ndarray) -> np.ndarray:
    """Rows of the sparse matrix times ``basis``, a few documents at a time, scaled to length 1."""
    out = np.zeros((n, basis.shape[1]), np.float32)
    cuts = np.searchsorted(doc, np.arange(0, n + BLOCK, BLOCK))
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            starts = np.flatnonzero(np.diff(doc[a:b], prepend=-1))
            out[doc[a:b][starts]] = np.add.reduceat(basis[term[a:b]] * value[a:b, None].astype(np.float32), starts, axis=0)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def latent_basis(doc, term, value, n: int, width: int, rank: int, seed: int = 11) -> np.ndarray:
    """Right singular vectors of a sparse matrix by randomised subspace iteration."""
    rng = np.random.default_rng(seed)
    rank = max(1, min(rank, n))
    value = value.astype(np.float32)
    order = np.argsort(term, kind="stable")
    t_term, t_doc, t_value = term[order], doc[order], value[order]

    def product(row, column, weight, q, rows):  # a sparse matrix, sorted by row, times q
        out = np.zeros((rows, q.shape[1]), np.float32)
        for at in range(0, len(row), PAIRS):
            part = slice(at, at + PAIRS)
            starts = np.flatnonzero(np.diff(row[part], prepend=-1))
            out[row[part][starts]] += np.add.reduceat(q[column[part]] * weight[part, None], starts, axis=0)
        return out

    def times(q):
        return product(doc, term, value, q, n)

    def back(q):
        return product(t_term, t_doc, t_value, q, width)

    q = np.linalg.qr(times(rng.standard_normal((width, min(n, rank + 8))).astype(np.float32)))[0]
    for _ in range(3):
        q = np.linalg.qr(times(np.linalg.qr(back(q))[0]))[0]
    _, _, vt = np.linalg.svd(back(q).T, full_matrices=False)
    return np.ascontiguousarray(vt[:rank].T.astype(np.float32))


def learn(texts: list[str], labels: list[int], share: float, df: np.ndarray, n_docs: int):
    """(idf, basis, labelled vectors, vote of each for class 1 and for class 0)."""
    y = np.array(labels, int)
    idf = np.log((n_docs + 1) / (df + 1)) + 0.1
    if len(y) == 0 or y.min() == y.max():
        return idf, None, None, 0.5 if len(y) == 0 else float(y[0]), None
    n, whole = len(texts), pa.array(texts, pa.string())
    found = [(at, *terms(whole.slice(at, m))) for at, m in slices(whole)]
    doc, term, count = (np.concatenate(x) for x in zip(*[(at + d, t, c) for at, d, t, c in found], strict=True))
    value = weigh(doc, term, count, n, idf)
    basis = latent_basis(doc, term, value, n, len(idf), RANK)
    vectors = project(doc, term, value, n, basis)
    weight = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum()) * n
    return idf, basis, vectors, (weight * (y == 1)).astype(np.float32), (weight * (y == 0)).astype(np.float32)


def votes(texts: pa.Array, model) -> np.ndarray:
    """The share of class 1 among the neighbours' weighted votes."""
    idf, basis, vectors, one, zero = model
    n = len(texts)
    if basis is None:
        return np.full(n, one)
    doc, term, count = terms(texts)
    rows = project(doc, term, weigh(doc, term, count, n, idf), n, basis)
    out = np.empty(n)
    k = min(NEIGHBOURS, len(vectors))
    for at in range(0, n, BLOCK):
        cosine = rows[at : at + BLOCK] @ vectors.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        last = np.take_along_axis(cosine, near, 1).min(1, keepdims=True)
        for i in np.flatnonzero((cosine >= last).sum(1) > k):  # equal cosines at the end: by doc_id
            near[i] = np.argsort(-cosine[i], kind="stable")[:k]
        w = np.maximum(np.take_along_axis(cosine, near, 1), 1e-3) ** SHARPNESS
        a, b = (w * one[near]).sum(1), (w * zero[near]).sum(1)
        out[at : at + BLOCK] = a / np.maximum(a + b, 1e-30)
    return out


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = SAMPLE):
    bounded_batches(spark)
    df, n = document_frequencies(docs)
    return learn(*sample(spark, docs, labels, "quality", 4, 2, most), df, n)


def score(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """``docs`` with ``_quality_score``, between 0 and 1."""

    def run(batches):
        for batch, texts in parts(batches, text):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(votes(texts, model))], [*batch.schema.names, "_quality_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_quality_score", T.DoubleType())]))


def op5_latent_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all ``documents``; labels of the held-out fold are not learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"),
        F.col("_quality_score").alias("score"),
        (F.col("_quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
