"""Word units of texts, once per distinct word of a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 3 << 20  # text that a task works on at a time
SPELLED = 3  # so many single characters in a row are also read as one word


# Arrow's own pool keeps what it has freed; a reused worker should give it back
pa.set_memory_pool(pa.system_memory_pool())
BATCH_ROWS = 1000


def bounded_batches(spark) -> None:
    """Hand texts to Python workers in batches of at most ``BATCH_ROWS``: the default of 10,000 documents
    takes some 100 MB on either side, and far more where long ones stand together."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def release_shuffles(spark) -> None:
    """Have the files of a query's shuffles removed when it ends, not when the driver happens to collect
    garbage: the stages of a pipeline move all texts one after the other."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def as_text(column) -> pa.Array:
    """A column of texts with "" for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "")


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> list[tuple[int, int]]:
    """(first, count) runs of rows with about ``most`` bytes of text each, so that memory stays bounded."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def parts(batches, column: str, most: int = SLICE_BYTES):
    """(rows, texts) for runs of rows of the batches with about ``most`` bytes of text each."""
    for batch in batches:
        texts = as_text(batch.column(column))
        for at, n in slices(texts, most):
            yield batch.slice(at, n), texts.slice(at, n)


def code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the words, and the number of each word's."""
    text = "".join(words.to_pylist())
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), pc.utf8_length(words).to_numpy().astype(np.int64)


def word_units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct units, unit of each word, document of each word) of the texts.

    A unit is a white-space separated word in lower case, without anything but
    letters, accents and digits; a run of single characters ("i d i o t") also
    counts as the word that it spells.
    """
    words = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy())
    coded = words.flatten().dictionary_encode()
    clean = pc.replace_substring_regex(coded.dictionary, r"[^\p{L}\p{M}\p{N}]", "")
    again = clean.dictionary_encode()
    unit = again.indices.to_numpy()[coded.indices.to_numpy()]
    units = again.dictionary
    if len(units) == 0:
        return units, unit, doc
    single = (pc.utf8_length(units).to_numpy() == 1)[unit]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (single * (doc + 1)), [0]])))
    spelled, whose = [], []
    names = None
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if single[a] and b - a >= SPELLED:
            names = names or units.to_pylist()
            spelled.append("".join(names[i] for i in unit[a:b]))
            whose.append(doc[a])
    if spelled:
        unit = np.concatenate([unit, len(units) + np.arange(len(spelled))])
        doc = np.concatenate([doc, whose])
        units = pa.concat_arrays([units, pa.array(spelled, units.type)])
    return units, unit, doc


_POWERS = np.array([1], np.uint64)


def string_hash(words: pa.Array) -> np.ndarray:
    """A stable 64-bit hash of each string."""
    global _POWERS
    if len(words) == 0:
        return np.empty(0, np.uint64)
    kind = np.int32 if pa.types.is_string(words.type) else np.int64
    offsets = np.frombuffer(words.buffers()[1], kind, len(words) + 1 + words.offset)[words.offset :]
    size = np.diff(offsets).astype(np.int64)
    if int(size.max()) + 1 > len(_POWERS):
        _POWERS = np.cumprod(np.full(int(size.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if size.sum() else np.empty(0, np.uint8)
    h = size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    full = size > 0
    if full.any():
        begin = (offsets[:-1] - offsets[0])[full]
        at = np.arange(len(data), dtype=np.int32) - np.repeat(begin, size[full])
        h[full] += np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * _POWERS[at], begin)
    return mixed(h)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_ORDER = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): each text's distinct ``width``-word shingles, sorted, and where they end.

    Words are split at ASCII white space after lower-casing A-Z.  A text with
    fewer words has its whole word sequence as one shingle, one without words none.
    """
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy())
    coded = words.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    full = (pc.binary_length(coded.dictionary).to_numpy() > 0)[codes]
    codes, doc = codes[full], doc[full]
    word = string_hash(coded.dictionary)[codes]
    n = np.bincount(doc, minlength=len(texts))
    begin = np.cumsum(n) - n
    spans = max(0, len(word) - width + 1)
    h = np.zeros(spans, np.uint64)
    for k in range(width):
        h += word[k : k + spans] * _ORDER[k]
    h = mixed(h)
    out, size = [], np.zeros(len(texts), np.int64)
    for i, (a, m) in enumerate(zip(begin.tolist(), n.tolist(), strict=True)):
        if m >= width:
            own = h[a : a + m - width + 1]
        elif m:
            own = mixed((word[a : a + m] * np.array(_ORDER[:m])).sum(keepdims=True) + np.uint64(m))
        else:
            continue
        own = np.unique(own)
        out.append(own)
        size[i] = len(own)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.cumsum(size)
