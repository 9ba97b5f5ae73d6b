"""Benchmark decontamination by latent semantic retrieval.

Words are hashed; documents are cut into passages for the model only.  The TF-IDF matrix ``A`` of all
passages, its terms folded into ``TERMS`` buckets, is decomposed by a distributed randomised
SVD: ``A'A`` is applied to a random block, the result is made orthonormal, ``A'A`` is applied once
more and the small matrix that is left gives the leading right singular vectors.  Each
application is one pass in which tasks add up their passages' part, and the parts are summed by
Spark; the driver sees ``TERMS`` rows whatever the corpus.

A text's latent vector is the sum of its words' vectors, each divided by its singular value, so
that frequent directions don't drown the others.  Every document is searched with windows
of about each item's length that overlap by three quarters; windows whose cosine with the item is at
least ``MIN_COSINE`` are candidates; it is so low that hardly any paraphrase which the checks accept is lost.
A bitmap of the words around a window bounds how many of the item's words can be there, for many candidates at
once; those with too few can't be accepted and go.  For the others the longest common subsequence of words with
the item is found in the window and half its length around.  A candidate is a leak if the
subsequence covers ``VERBATIM`` of the item, or ``PARAPHRASE`` of it and the item's answer (its last
``ANSWER_WORDS`` words) is there for ``MIN_ANSWER`` too.

All items are searched in one pass; only beyond ``ITEM_BLOCK`` items there is a pass for each block of so many.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialise

PASSAGE = 48
TERMS, RANK, OVERSAMPLE = 256, 96, 16
MIN_COSINE = 0.3
VERBATIM, PARAPHRASE, MIN_ANSWER, ANSWER_WORDS = 0.9, 0.65, 0.75, 8
#: Items that are broadcast together, and cosines that are computed at once.
ITEM_BLOCK, COSINES = 20_000, 1 << 22
#: Bits of a bitmap of words, and words of texts that are searched at once (or one text).
BITS, GROUP_WORDS = 1024, 32_768
#: Rows of a task's matrix that are sent together.
BLOCK = 32
BLOCKS = "block int, part int, values array<double>"
#: Bytes of texts whose words are hashed at once (or one text).
PIECE = 1 << 22
PUNCTUATION = ".,;:!?\"'()[]{}«»“”‘’¿¡-–—…"


class WordHash:
    """32-bit hashes of lower-case words without punctuation around them."""

    def __call__(self, text: str | None) -> np.ndarray:
        return self.column(pa.array([text], pa.string()))[0]

    def column(self, texts: pa.Array) -> list[np.ndarray]:
        """The word hashes of each text.  Words are cut and told apart by Arrow, so that each different one is hashed once."""
        split = pc.utf8_split_whitespace(texts.fill_null(""))
        words = split.flatten().dictionary_encode()
        lower = [*map(str.lower, words.dictionary.to_numpy(zero_copy_only=False))]
        values = np.fromiter((xxhash.xxh32_intdigest(w.strip(PUNCTUATION) or w) for w in lower), np.uint32, len(lower))
        at, ends = words.indices.to_numpy(), np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy())])
        if "" in lower:  # stands before white space at the beginning and after it at the end
            real = at != lower.index("")
            at, ends = at[real], np.concatenate([[0], np.cumsum(real)])[ends]
        ids = values[at]
        return [ids[a:b] for a, b in itertools.pairwise(ends.tolist())]


def pieces(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of ``PIECE`` bytes of text, or one row."""
    ends, at = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy().astype(np.int64)), 0
    while at < batch.num_rows:
        size = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")) - at)
        yield batch.slice(at, size)
        at += size


def hashed(docs: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` without the text, and ``_ids``: its word hashes, four bytes each."""
    keep = [f for f in docs.schema.fields if f.name not in (text, "_ids")]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_hash = WordHash()
        for batch in batches:
            for part in pieces(batch, text):
                ids = [x.tobytes() for x in word_hash.column(part.column(text))]
                yield pa.RecordBatch.from_arrays([*part.select(names).columns, pa.array(ids, pa.binary())], [*names, "_ids"])

    return docs.select(*names, text).mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "_ids binary"]))


def counts(batches: Iterator[pa.RecordBatch], terms: int) -> Iterator[np.ndarray]:
    """Term counts of passages, some thousand rows at a time."""
    held, size = [], 0
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            bucket = (np.frombuffer(raw, np.uint32) % terms).astype(np.int64)
            if len(bucket):
                rows = -(-len(bucket) // PASSAGE)
                at = np.arange(len(bucket)) // PASSAGE * terms + bucket
                held.append(np.bincount(at, minlength=rows * terms).reshape(rows, terms).astype(np.float32))
                size += rows
            if size >= 4096:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def blocks_of(values: np.ndarray) -> pa.RecordBatch:
    """A task's matrix as rows (block, part, values) of ``BLOCK`` rows of it each."""
    flat = [values[at:at + BLOCK].ravel() for at in range(0, len(values), BLOCK)]
    return pa.RecordBatch.from_arrays(
        [pa.array(range(len(flat)), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(flat), pa.int32()),
         pa.array(flat, pa.list_(pa.float64()))], ["block", "part", "values"])


def summed(parts: DataFrame, width: int) -> np.ndarray:
    """Sum over tasks of ``blocks_of`` their matrices (``TERMS`` rows).  In two steps, so that the
    tasks of a very large job don't meet in one group a block."""
    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": rows["block"][:1], "part": rows["part"][:1], "values": [np.sum(np.stack(rows["values"]), axis=0)]})

    first = parts.withColumn("part", F.col("part") % 8).groupBy("block", "part").applyInPandas(add, BLOCKS)
    total = first.withColumn("part", F.lit(0)).groupBy("block", "part").applyInPandas(add, BLOCKS)
    out = np.zeros((TERMS, width))
    for r in total.collect():  # TERMS rows in all
        out[r["block"] * BLOCK:(r["block"] + 1) * BLOCK] = np.reshape(r["values"], (-1, width))
    return out


class LatentModel:
    """A vector for each term bucket."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = np.ascontiguousarray(vectors, np.float32)

    def words(self, ids: np.ndarray) -> np.ndarray:
        return self.vectors[ids % len(self.vectors)]

    def blocks(self, at: np.ndarray, ids: np.ndarray, n: int, size: int) -> np.ndarray:
        """Sums over ``n`` blocks of ``size`` places each, of the vectors of the words ``ids`` at the places ``at``; the other places are empty."""
        vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors[:1])])
        term = np.full(n * size, len(self.vectors))
        term[at] = ids % len(self.vectors)
        term = np.ascontiguousarray(term.reshape(n, size).T)
        out = vectors.take(term[0], axis=0, mode="clip")
        for k in range(1, size):
            out += vectors.take(term[k], axis=0, mode="clip")
        return out


def fit(ids: DataFrame, seed: int = 0) -> LatentModel:
    """Randomised SVD of the TF-IDF passages of all rows of ``ids`` (column ``_ids``).

    Without passages the vectors are random, which leaves the cosine as a hashed word overlap."""
    rank, rng = RANK, np.random.default_rng(seed)
    only = ids.select("_ids")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((TERMS, 2))
        for c in counts(batches, TERMS):
            out[:, 0] += (c > 0).sum(axis=0)
            out[:, 1] += len(c)
        if out.any():
            yield blocks_of(out)

    found = summed(only.mapInArrow(frequencies, BLOCKS), 2)
    passages = found[:, 1].max()
    idf = np.log((passages + 1) / (found[:, 0] + 1)) + 1e-3
    if not passages:
        return LatentModel(rng.standard_normal((TERMS, rank)))

    def apply(block: np.ndarray) -> np.ndarray:
        """``A'A block`` over all passages."""
        shared = only.sparkSession.sparkContext.broadcast((idf.astype(np.float32), block.astype(np.float32)))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weight, right = shared.value
            out = np.zeros(right.shape)
            for c in counts(batches, TERMS):
                c *= weight
                out += c.T @ (c @ right)
            if out.any():
                yield blocks_of(out)

        return summed(only.mapInArrow(task, BLOCKS), block.shape[1])

    basis, _ = np.linalg.qr(apply(rng.standard_normal((TERMS, min(TERMS, rank + OVERSAMPLE)))))
    small = basis.T @ apply(basis)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(values)[::-1][:rank]
    order = order[values[order] > 1e-6 * values.max()]  # fewer where there are fewer passages
    singular = np.sqrt(values[order])
    return LatentModel(basis @ turn[:, order] / singular * idf[:, None])


def common_subsequence(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over the item."""
    masks: dict[int, int] = {}
    for k, x in enumerate(item):
        masks[x] = masks.get(x, 0) | 1 << k
    full = (1 << len(item)) - 1
    v = full
    for x in text:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def bitmaps(rows: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` rows a bitmap of the words ``ids`` in it."""
    out = np.zeros((n, BITS // 64), np.uint64)
    bit = ids % BITS
    np.bitwise_or.at(out, (rows, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out


class Search:
    """A block of items, ready to be looked for in documents."""

    def __init__(self, model: LatentModel, items: list[tuple[object, np.ndarray]]) -> None:
        self.model = model
        self.items = [(key, ids.tolist()) for key, ids in items if len(ids)]
        self.times = [Counter(ids) for _, ids in self.items]
        lengths = np.array([len(ids) for _, ids in self.items], np.int64)
        everything = np.array([x for _, ids in self.items for x in ids], np.uint32)
        self.bits = bitmaps(np.repeat(np.arange(len(lengths)), lengths), everything, len(lengths))
        # bits that must be around: the words that share a bit with another of the item count as there
        self.least = np.ceil(PARAPHRASE * lengths - 1e-9) - (lengths - np.bitwise_count(self.bits).sum(axis=1))
        self.by_window: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        groups: dict[int, list[int]] = {}
        self.window = [max(4, 1 << round(np.log2(len(ids)))) for _, ids in self.items]
        for k, window in enumerate(self.window):
            groups.setdefault(window, []).append(k)
        for window, members in groups.items():
            v = np.array([model.words(np.array(self.items[k][1])).sum(axis=0) for k in members])
            v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-9
            self.by_window[window] = np.array(members), np.ascontiguousarray(v.T, np.float32)

    def candidates(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, item, first word, end, cosine) of the windows that are like an item and may hold enough of its words.

        The texts stand one after the other, each followed by room for three blocks, so no window reaches into the next."""
        # sums and bitmaps of so many words; a window is four of them, and twice as many words are two of them
        finest, largest = min(self.by_window, default=4) // 4, max(self.by_window, default=4) // 4
        lengths = np.array([len(x) for x in texts], np.int64)
        coarse = -(-lengths // largest) + 3
        first = (np.cumsum(coarse) - coarse) * largest  # a text's first place
        at = np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        ids, n = np.concatenate(texts), int(coarse.sum()) * largest // finest
        blocks, maps = {finest: self.model.blocks(at, ids, n, finest)}, {finest: bitmaps(at // finest, ids, n)}
        step = finest
        while step < largest:
            b, m = blocks[step], maps[step]
            step *= 2
            blocks[step], maps[step] = b[0::2] + b[1::2], m[0::2] | m[1::2]
        for window, (members, right) in self.by_window.items():
            step = window // 4
            b, m = blocks[step], maps[step]
            # a window begins with each block of a text but its last three, and with the first one
            begins = np.maximum(1, -(-lengths // step) - 3) * (lengths > 0)
            of = np.repeat(np.arange(len(texts)), begins)
            place = first[of] // step + np.arange(len(of)) - np.repeat(np.cumsum(begins) - begins, begins)
            w = b[:-3] + b[1:-2]
            w += b[2:-1]
            w += b[3:]
            size = max(64, COSINES // len(members))
            for start in range(0, len(place), size):
                part = w[place[start:start + size]]
                norm = np.sqrt(np.einsum("ij,ij->i", part, part)) + 1e-9
                inner = part @ right
                alike = np.flatnonzero(inner >= (MIN_COSINE * norm)[:, None])
                for some in range(0, len(alike), 1 << 16):
                    r, c = np.divmod(alike[some:some + (1 << 16)], len(members))
                    item = members[c]
                    # words of a window and three quarters of it around, which is more than half of any item it stands for
                    new = np.concatenate([[True], r[1:] != r[:-1]])
                    windows = place[start + r[new]]
                    around = m[windows]
                    for shift in (-3, -2, -1, 1, 2, 3, 4, 5, 6):  # the first and last block again where there are no more
                        around |= m.take(windows + shift, axis=0, mode="clip")
                    there = np.bitwise_count(around[np.cumsum(new) - 1] & self.bits[item]).sum(axis=1, dtype=np.int16)
                    for k in np.flatnonzero(there >= self.least[item]):
                        text = int(of[start + r[k]])
                        word = int(place[start + r[k]]) * step - int(first[text])
                        yield text, int(item[k]), word, min(word + window, int(lengths[text])), float(inner[r[k], c[k]] / norm[r[k]])

    def leaks(self, texts: list[np.ndarray]) -> list[list[tuple[object, int, int, float, float, float]]]:
        """For each text (item key, first word, words, cosine, share in order, share of the answer) of each item
        found, at its best window."""
        out: list[list[tuple]] = []
        for group in self.groups(texts):
            best: list[dict[int, tuple]] = [{} for _ in group]
            for t, k, start, end, cosine in self.candidates(group):
                item = self.items[k][1]
                around = max(1, len(item) // 2)
                text = group[t][max(0, start - around):end + around].tolist()
                # a subsequence has at most the item's words that are there
                if sum(map(self.times[k].__getitem__, self.times[k].keys() & set(text))) < PARAPHRASE * len(item):
                    continue
                share = common_subsequence(item, text) / len(item)
                if share < PARAPHRASE:
                    continue
                tail = item[-ANSWER_WORDS:]
                answer = common_subsequence(tail, text) / len(tail)
                if share >= VERBATIM or answer >= MIN_ANSWER:
                    found = (share, answer, cosine, -start, end - start)
                    if found > best[t].get(k, ()):
                        best[t][k] = found
            out += [[(self.items[k][0], -f[3], f[4], f[2], f[0], f[1]) for k, f in sorted(x.items())] for x in best]
        return out

    def groups(self, texts: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        """The texts in groups that are searched at once."""
        held, n = [], 0
        for x in texts:
            held.append(x)
            n += len(x)
            if n >= GROUP_WORDS:
                yield held
                held, n = [], 0
        if held:
            yield held


def item_blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[object, np.ndarray]]]:
    """The items in blocks of ``ITEM_BLOCK``, in the order of their key and text; null keys and texts are left out."""
    last = None
    rows = items.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key IS NOT NULL AND text IS NOT NULL").dropDuplicates()
    while True:
        after = F.lit(True) if last is None else (F.col("key") > last["key"]) | ((F.col("key") == last["key"]) & (F.col("text") > last["text"]))
        block = rows.where(after).orderBy("key", "text").limit(ITEM_BLOCK).collect()
        if not block:
            return
        yield [*zip((r["key"] for r in block), WordHash().column(pa.array([r["text"] for r in block], pa.string())), strict=True)]
        last = block[-1]


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(key, item key, first_word, n_words, cosine, lcs_share, answer_share): each item found in each row of
    ``docs``, at its best window.

    Null or empty texts hold nothing and empty items are found nowhere.  Repeated rows are searched
    each.  A key given to several items counts as one item for each text of it; item keys may be of any type that sorts."""
    ids = materialise(hashed(docs.select(key, text), text))
    model = fit(ids)
    kind = docs.schema[key].dataType.simpleString()
    item_kind = items.schema[item_key].dataType
    schema = f"`{key}` {kind}, `{item_key}` {item_kind.simpleString()}, first_word long, n_words long, cosine double, lcs_share double, answer_share double"
    found = None
    for block in item_blocks(items, item_key, text):
        shared = docs.sparkSession.sparkContext.broadcast((model, block))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = Search(*shared.value)
            for batch in batches:
                rows, places = [], []
                for k, leaks in enumerate(own.leaks([np.frombuffer(raw, np.uint32) for raw in batch.column("_ids").to_pylist()])):
                    places += [k] * len(leaks)
                    rows += leaks
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                kinds = (to_arrow_type(item_kind), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(places, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                                                 [key, item_key, "first_word", "n_words", "cosine", "lcs_share", "answer_share"])

        now = ids.mapInArrow(search, schema)
        found = now if found is None else found.unionByName(now)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, items: DataFrame, item_key: str = "item_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, whatever its key (also null); columns as they are."""
    items = items.select(F.lit(0).alias(item_key), text)  # each text once
    model = fit(materialise(hashed(docs.select(text), text)))
    names = docs.columns
    for block in item_blocks(items, item_key, text):
        shared = docs.sparkSession.sparkContext.broadcast((model, block))

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, word_hash = Search(*shared.value), WordHash()
            for batch in batches:
                for part in pieces(batch, text):
                    kept = [k for k, leaks in enumerate(own.leaks(word_hash.column(part.column(text)))) if not leaks]
                    yield part.take(pa.array(kept, pa.int64())).select(names)

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
