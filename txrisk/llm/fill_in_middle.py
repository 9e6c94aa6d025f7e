"""Fill-in-the-middle transformation with memoised content-defined chunks.

A text is cut into units (white space with the word after it; white space at
the end is a unit of its own).  Three spans, from two hashes of the document's
id, become prefix, middle and suffix, and the document is written plain, as
prefix-suffix-middle or as suffix-prefix-middle.

Counting units and finding the two cuts is the work, and much of a corpus
repeats.  So texts are cut into chunks where a rolling hash of the last
``WINDOW`` bytes says so, which puts equal passages into equal chunks wherever
they stand.  A chunk is looked up by its content (equal hashes are compared byte
for byte) in a cache of boundary summaries: code points, words, and whether its
first and last character belong to a word.  Summaries of neighbours combine: a
word that spans an edge is counted once.  The sums along a document say in which
chunk a cut lies, and only that chunk is searched.  Chunks only share work: cuts
are the same for any window, mask or cache size.

Python sees texts and returns three numbers for each; the caller's columns stay
in the JVM, where output and restored text are built.  No row meets another, so
nothing is shuffled and no key can be hot.

Defined cases: a null text counts as empty; an empty text is plain, with 0
units; a text that holds a marker is plain; a null id hashes as the seed's text
without digits; repeated rows give repeated results; an empty table gives no
rows; all columns of the input are kept, and the result is one struct under a
name that the caller can choose.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm.units import as_text, slices

SEED = 42
FIM_PERCENT = 50  # documents that are transformed
SPM_PERCENT = 80  # of these, suffix first
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
WINDOW_BITS = 4  # the rolling hash covers 2**WINDOW_BITS bytes
MASK = np.uint32(0xFF000000)  # a chunk ends on average after 256 bytes beyond the least
LEAST, MOST = 64, 4096  # bytes of a chunk
CACHE_BYTES = 32 << 20  # of chunks that a task remembers
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SPACE = frozenset(b" \t\n\v\f\r")
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """The hash of the last ``2**WINDOW_BITS`` bytes at every byte, by doubling the window."""
    h = _GEAR[data]
    for k in range(WINDOW_BITS):
        w = 1 << k
        longer = h.copy()
        longer[w:] += h[:-w] << np.uint32(w)
        h = longer
    return h


def chunk_ends(data: np.ndarray, ends: list[int]) -> list[list[int]]:
    """For each text of the concatenated bytes, the ends of its chunks; no chunk splits a code point."""
    start = np.append((data[1:] & 0xC0) != 0x80, True)  # a code point begins after this byte
    found = np.flatnonzero(((rolling(data) & MASK) == 0) & start) + 1
    cut = np.searchsorted(found, ends, side="left")
    out, begin, first = [], 0, 0
    for end, last_cut in zip(ends, cut.tolist(), strict=True):
        own, last = [], begin
        for at in [*found[first:last_cut].tolist(), end]:
            while at - last > MOST:
                last += MOST
                while not start[last - 1]:
                    last -= 1
                own.append(last)
            if at - last >= LEAST or (at == end and at > last):
                own.append(at)
                last = at
        out.append(own)
        begin, first = end, last_cut
    return out


class Summaries:
    """(code points, words, begins in a word, ends in a word) of chunks, remembered by content."""

    def __init__(self, room: int = CACHE_BYTES):
        self.room, self.used, self.known = room, 0, {}
        self.asked = self.hits = 0

    def of(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        self.asked += 1
        found = self.known.get(chunk)
        if found is not None:
            self.hits += 1
            return found
        found = (len(chunk.decode()), len(chunk.split()), chunk[0] not in SPACE, chunk[-1] not in SPACE)
        if self.used + len(chunk) > self.room:
            self.known, self.used = {}, 0
        self.known[chunk] = found
        self.used += len(chunk)
        return found


class Cuts:
    """Units of one text, and the code point at which a number of them ends."""

    def __init__(self, chunks: list[bytes], memo: Summaries):
        self.chunks = chunks
        self.seen = [memo.of(c) for c in chunks]
        self.before: list[tuple[int, int, bool]] = []  # code points and words that begin earlier; the chunk goes on with a word
        chars = words = 0
        inside = False
        for n, w, first, last in self.seen:
            joined = inside and first
            self.before.append((chars, words, joined))
            chars, words, inside = chars + n, words + w - joined, last
        self.chars, self.words = chars, words
        self.units = words + (bool(chunks) and not inside)

    def end_of(self, k: int) -> int:
        """Code points of the first ``k`` units."""
        if k <= 0:
            return 0
        if k > self.words:
            return self.chars
        at = self._holding(k)
        chars, words, joined = self.before[at]
        local = k - words + joined  # which of the chunk's words
        if local == self.seen[at][1] and self.seen[at][3]:  # it may go on beyond the chunk
            at += 1
            while at < len(self.chunks) and self.seen[at][2] and self.seen[at][1] == 1 and self.seen[at][3]:
                at += 1
            if at == len(self.chunks):
                return self.chars
            if not self.seen[at][2]:
                return self.before[at][0]
            chars, local = self.before[at][0], 1
        chunk = self.chunks[at]
        for i, word in enumerate(WORD.finditer(chunk), 1):
            if i == local:
                return chars + len(chunk[: word.end()].decode())
        raise AssertionError("summaries disagree with their chunk")

    def _holding(self, k: int) -> int:
        """The chunk in which the k-th word begins."""
        low, high = 0, len(self.before) - 1
        while low < high:
            mid = (low + high + 1) // 2
            if self.before[mid][1] < k:
                low = mid
            else:
                high = mid - 1
        return low


def cut(texts: pa.Array, h1: np.ndarray, h2: np.ndarray, memo: Summaries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, end of the prefix, end of the middle) of each text."""
    n, a, b = (np.zeros(len(texts), np.int64) for _ in range(3))
    for at, size in slices(texts):
        raw = [t.encode() for t in texts.slice(at, size).to_pylist()]
        data = b"".join(raw)
        ends = np.cumsum([len(t) for t in raw]).tolist()
        if not data:
            continue
        begin = 0
        for i, chunks in enumerate(chunk_ends(np.frombuffer(data, np.uint8), ends), at):
            edges = [begin, *chunks]
            cuts = Cuts([data[x:y] for x, y in zip(edges, edges[1:], strict=False)], memo)
            low, high = sorted((int(h1[i]) % (cuts.units + 1), int(h2[i]) % (cuts.units + 1)))
            n[i], a[i], b[i] = cuts.units, cuts.end_of(low), cuts.end_of(high)
            begin = edges[-1]
    return n, a, b


def _cuts(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    memo = Summaries()
    for text, h1, h2 in columns:
        found = cut(as_text(text), h1.to_numpy(), h2.to_numpy(), memo)
        yield pa.StructArray.from_arrays([pa.array(x) for x in found], ["n", "low", "high"])


def id_hashes(doc_id: Column, seed: int = SEED) -> list[Column]:
    """The first four groups of eight digits of the hash of ``seed:doc_id``, as numbers."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    docs: DataFrame, into: str = "fim", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT
) -> DataFrame:
    """``docs`` with a struct (n, form, prefix_chars, middle_chars, output); the lengths are null for plain texts."""
    units = F.arrow_udf(_cuts, "struct<n:long,low:long,high:long>")
    text = F.coalesce(F.col("text"), F.lit(""))
    h1, h2, h3, h4 = id_hashes(F.col("doc_id"), seed)
    found = units(text, h1, h2)
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains(text, F.lit(mark))
    plain = (text == "") | marked | (h3 % 100 >= fim_percent)
    form = F.when(plain, F.lit("plain")).when(h4 % 100 < spm_percent, F.lit("spm")).otherwise(F.lit("psm"))
    low, high = found["low"], found["high"]
    prefix, middle = (F.substring(text, F.lit(1), low.cast("int")), F.substring(text, (low + 1).cast("int"), (high - low).cast("int")))
    suffix = F.substring(text, (high + 1).cast("int"), F.length(text))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(form == "plain", text).when(form == "spm", spm).otherwise(psm)
    cells = [
        found["n"].alias("n"), form.alias("form"), F.when(form != "plain", low).alias("prefix_chars"),
        F.when(form != "plain", high - low).alias("middle_chars"), output.alias("output"),
    ]
    return docs.withColumn(into, F.struct(*cells))


def restored(output: Column, form: Column) -> Column:
    """The text from which an output was made: the parts between the markers in their first order."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)))
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
    )


def op11_chunk_memo_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` with the fill-in-the-middle form of their whole texts, as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = fill_in_middle(docs)
    return out.select(
        "doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars",
        F.sha2("fim.output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("fim.output"), F.col("fim.form")), 256).alias("restored_sha256"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
k AS (SELECT doc_id, text, units, len(units)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high FROM k),
p AS (SELECT doc_id, n, text, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle,
    array_to_string(units[high + 1:], '') AS suffix,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
