"""Token counts of whole texts, without ids.

A SentencePiece BPE model without pieces that continue across a space splits a text the same
way whether it sees the whole text or its pre-tokens (a run of spaces and what follows up to
the next space) one by one.  So pieces are counted once per distinct pre-token and joined
to the pre-token frequencies of each document:

* the most frequent pre-tokens (at most ``MAX_FREQUENT``, a bound on what is broadcast) are found
  in a first pass, counted once, and joined to the frequencies as a broadcast table;
* all others meet their documents by a shuffle on the pre-token.  No pre-token that is left
  holds a large share of the rows, since the frequent ones are gone.

Which way a pre-token goes changes nothing in the counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of a task's pre-tokens from which one is a candidate for the broadcast table, and
#: that table's largest size.
FREQUENT_SHARE = 4e-6
MAX_FREQUENT = 200_000
#: Distinct pre-tokens a task holds while it looks for frequent ones; beyond it the rarest go.
MAX_HELD = 1_000_000
SPACE_MARK = "▁"


def model_path(model: str) -> str:
    """``model`` itself if it is a path, else the place of that public tokenizer file."""
    if "/" in model:
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


def load(model: str):
    """The processor for a model file; raises if its pieces could span pre-tokens."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path(model))
    if any(SPACE_MARK in sp.id_to_piece(i).lstrip(SPACE_MARK) for i in range(sp.get_piece_size())):
        raise ValueError(f"{model}: pieces continue across spaces, so pre-tokens can't be counted alone")
    return sp


def pre_tokens(text: str) -> Counter:
    """Frequencies of a text's pre-tokens, each without its first space.

    The model puts a space before the text and reads its space mark as a space."""
    if not text:
        return Counter()
    text = text.replace(SPACE_MARK, " ")
    found = Counter(text.split(" "))
    if "" in found:  # runs of spaces, or one at an end
        found = Counter(x[1:] for x in re.findall(" +[^ ]*", " " + text))
    return found


def piece_counts(sp, tokens: list[str]) -> list[int]:
    """Pieces of each pre-token; the empty one is a single space mark."""
    return [len(ids) if t else 1 for t, ids in zip(tokens, sp.encode(tokens, num_threads=1), strict=True)]


def frequent_pre_tokens(docs: DataFrame, text: str) -> DataFrame:
    """(pre, n) of the most frequent pre-tokens, at most ``MAX_FREQUENT``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = Counter(), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                own = pre_tokens(t or "")
                held.update(own)
                total += own.total()
            while len(held) > MAX_HELD:
                floor = sorted(held.values())[len(held) // 2]
                held = Counter({k: v for k, v in held.items() if v > floor})
        found = [(k, v) for k, v in held.items() if v >= max(2, FREQUENT_SHARE * total)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()),
                                          pa.array([v for _, v in found], pa.int64())], ["pre", "n"])

    return (docs.select(text).mapInArrow(count, "pre string, n long")
            .groupBy("pre").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pre").limit(MAX_FREQUENT))


def count_tokens(docs: DataFrame, model: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` without the text, with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    No begin, end or other special tokens are added; their strings inside a text are ordinary
    text, as the library has it.  A null text counts as empty: no bytes, no tokens.  Repeated
    rows all come back.  Columns of ``docs`` with the new names are replaced.  Rows are told
    apart by their place in ``docs``, which must read the same twice (a table does; write a
    computed frame first).
    """
    spark = docs.sparkSession
    new = ["n_bytes", "n_tokens", "over_limit", "_row"]
    rows = docs.drop(*(c for c in new if c != text)).withColumn("_row", F.monotonically_increasing_id())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = load(model)
        for batch in batches:
            tokens = batch.column("pre").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("pre"), pa.array(piece_counts(sp, tokens), pa.int64())], ["pre", "pieces"])

    frequent = frequent_pre_tokens(docs, text).select("pre").mapInArrow(counted, "pre string, pieces long").collect()
    table = spark.sparkContext.broadcast({r["pre"]: r["pieces"] for r in frequent})  # at most MAX_FREQUENT

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per document for its frequent pre-tokens, with their pieces as ``n``; a row for each
        other pre-token, with its frequency."""
        known = table.value
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                at, pre, n = [], [], []
                for row, t in zip(part.column("_row").to_pylist(), part.column(text).to_pylist(), strict=True):
                    total = 0
                    for token, times in pre_tokens(t or "").items():
                        pieces = known.get(token)
                        if pieces is None:
                            at.append(row)
                            pre.append(token)
                            n.append(times)
                        else:
                            total += times * pieces
                    at.append(row)
                    pre.append(None)
                    n.append(total)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(pre, pa.string()), pa.array(n, pa.int64())], ["row", "pre", "n"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows of a pre-token are in one task, which counts its pieces once."""
        sp, known = load(model), {}
        for batch in batches:
            pre = batch.column("pre").to_pylist()
            fresh = list({t for t in pre if t is not None and t not in known})
            known.update(zip(fresh, piece_counts(sp, fresh), strict=True))
            n = [x if t is None else x * known[t] for t, x in zip(pre, batch.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n, pa.int64())], ["row", "n"])

    pieces = (rows.select("_row", text).mapInArrow(split, "row long, pre string, n long")
              .repartition(F.coalesce(F.xxhash64("pre") + F.when(F.col("pre").isNull(), None).otherwise(0), F.hash("row").cast("long")))
              .mapInArrow(join, "row long, n long")
              .groupBy("row").agg(F.sum("n").alias("n_tokens")))
    return (rows.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).drop(text)
            .join(pieces, F.col("_row") == F.col("row"))
            .drop("_row", "row")
            .withColumn("over_limit", F.col("n_tokens") > limit))
