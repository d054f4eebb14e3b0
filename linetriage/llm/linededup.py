"""Delete later copies of runs of lines, found by winnowing over line hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

WORDS = 50  # words that a run of lines must hold
PRIME = (1 << 127) - 1  # modulus of the rolling hash over lines,
BASE = 0x9E3779B97F4A7C15F39CC0605CEDC835 % PRIME  # and its base


def windows(text: str, words: int = WORDS) -> Iterator[tuple[int, int]]:
    """Shortest runs (first, last line) of at least ``words`` words, from every line on and up to every line."""
    counts = np.array([len(line.split()) for line in text.split("\n")])
    total = np.concatenate([[0], np.cumsum(counts)])
    n = len(counts)
    last = np.searchsorted(total, total[:-1] + words)
    first = np.searchsorted(total, total[1:] - words, side="right") - 1
    seen = set()
    for i in range(n):
        for run in ((i, int(last[i]) - 1), (int(first[i]), i)):
            if 0 <= run[0] and run[1] < n and total[run[1] + 1] - total[run[0]] >= words and run not in seen:
                seen.add(run)
                yield run


def smallest(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of ``values`` in each range: from minima over all ranges of 1, 2, 4, ... values."""
    steps = [values]
    while 2 ** len(steps) <= len(values):
        half = 2 ** (len(steps) - 1)
        steps.append(np.minimum(steps[-1][:-half], steps[-1][half:]))
    level = np.frexp(last - first + 1.0)[1] - 1
    out = np.empty(len(first), values.dtype)
    for k in np.unique(level).tolist():
        at = level == k
        out[at] = np.minimum(steps[k][first[at]], steps[k][last[at] + 1 - 2**k])
    return out


def fingerprints(text: str, words: int = WORDS) -> Iterator[tuple[int, bytes, int, int]]:
    """(fingerprint, digest, first, last) of every window: the smallest line hash in it, and its content.

    Two copies of a window select the same line, so any run of lines with ``words`` words in common has
    a fingerprint in common. Digests are differences of one rolling hash over the lines, so the time is
    linear in the lines, also where windows hold very many empty ones.
    """
    if text.count(" ") + text.count("\n") + 1 < words and len(text.split()) < words:
        return
    raw = text.encode().split(b"\n")
    hashes = [xxhash.xxh3_64_intdigest(line) for line in raw]
    spans = list(windows(text, words))
    if not spans:
        return
    upto, power = [0], [1]
    for h in hashes:
        upto.append((upto[-1] * BASE + h + 1) % PRIME)
        power.append(power[-1] * BASE % PRIME)
    first, last = np.array(spans, np.int64).T
    minima = smallest(np.array(hashes, np.uint64).astype(np.int64), first, last)
    for (a, b), least in zip(spans, minima.tolist()):
        digest = (upto[b + 1] - upto[a] * power[b + 1 - a]) % PRIME
        yield least, digest.to_bytes(16, "big"), a, b


def repeated(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, spans): the line ranges of every document that hold a copy of earlier lines.

    Windows meet by fingerprint and content; the first place in order of (doc_id, line) is kept, and
    only minima leave a task before the shuffle, so a passage in a third of all documents is one row per
    task. Neighbouring windows that match extend each other to whole runs, in both directions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [
                    (f, d, i, a, b) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())
                    for f, d, a, b in fingerprints(t or "", words)]
                columns = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32()))],
                    names=["fingerprint", "digest", "doc_id", "first", "last"])

    places = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").where("doc_id is not null").mapInArrow(
        run, "fingerprint long, digest binary, doc_id long, first int, last int")
    places = places.select("fingerprint", "digest", F.struct("doc_id", "first", "last").alias("place"))
    earliest = places.groupBy("fingerprint", "digest").agg(F.min("place").alias("kept"), F.max("place").alias("latest")).where(
        "latest > kept").select("fingerprint", "digest", "kept")
    return (
        places.join(earliest, ["fingerprint", "digest"]).where("place > kept")
        .groupBy("place.doc_id").agg(F.collect_set(F.struct("place.first", "place.last")).alias("spans"))
    )


def without(text: str, spans: list) -> tuple[str, int]:
    """The text without the lines of all spans, and how many lines went."""
    lines = text.split("\n")
    gone = np.zeros(len(lines), bool)
    for span in spans:
        gone[span["first"] : span["last"] + 1] = True
    return "\n".join(line for line, g in zip(lines, gone) if not g), int(gone.sum())


def dedup_lines(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...) with later copies of line runs deleted from the text.

    A run of whole consecutive lines with at least ``words`` words is deleted wherever it also occurs at
    an earlier (doc_id, line); of equal runs in a document the first stays. Adds ``removed_lines`` (one of the
    input is replaced); where there is an ``n_chars`` column, it follows the text. Null texts and texts without such runs come back
    as they are; a text all of whose lines go becomes empty. Rows with a null doc_id are left alone. Rows
    with the same doc_id count as one place: what one of them holds is not a copy of the other. An empty
    table gives no rows.
    """
    spans = repeated(docs, words).withColumnRenamed("doc_id", "_llm_id").withColumnRenamed("spans", "_llm_spans")

    @F.pandas_udf("text string, removed long")
    def cleaned(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = [(t, 0) if t is None or s is None else without(t, s) for t, s in zip(text, spans)]
        return pd.DataFrame(out, columns=["text", "removed"])

    # Marked so that a later filter on its result is not a second evaluation below it.
    once = cleaned.asNondeterministic()
    joined = docs.join(spans, F.col("doc_id").cast("long") == F.col("_llm_id"), "left")
    done = joined.withColumn("_llm_done", once(F.col("text").cast("string"), "_llm_spans"))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("_llm_done.text").alias("text"))
        elif c == "n_chars":
            kept = F.when(F.col("_llm_done.removed") > 0, F.length("_llm_done.text")).otherwise(F.col("n_chars"))
            columns.append(kept.cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        elif c != "removed_lines":
            columns.append(F.col(f"`{c}`"))
    return done.select(*columns, F.col("_llm_done.removed").alias("removed_lines"))
