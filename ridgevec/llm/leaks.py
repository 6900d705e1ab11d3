"""Problem 7: passages of held-out items inside corpus documents.

Containment search by MinHash, partitioned by size. A short item inside a long
document has a small Jaccard similarity to all of it: LSH bands for containment
``t`` of ``q`` shingles in a set of up to ``u`` have to find Jaccard
``t / (u / q + 1 - t)``, and for 8 shingles in a thousand that takes hundreds
of bands. So both sides are cut into the sets of the partition that the question
is about, runs of ``RUN`` words as the set of their ``RUN - SHINGLE + 1`` word
shingles: there ``u = q``, containment 1 is Jaccard 1 (:func:`jaccard`), and one
band loses nothing. Its ``ROWS`` MinHash values make the signature. Neighbouring
runs mostly share it, so a text has fewer signatures than words.

Signatures of items and documents are joined: by broadcast where those of the
items are written as a small enough table, else by shuffle. The corpus is
scanned once, however many items there are. Each pair of texts found is
verified by exact containment of the run's shingles, word by word.

Words are runs of letters and digits after compatibility decomposition, without
case and accents; what stands in round or square brackets is left out before.
Null and blank texts, and items or documents of fewer words than a run, match
nothing; null ids are no documents or items. Repeated rows give one row.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgevec.session import table, written

#: Words of a run and of a shingle, MinHash values of a signature.
RUN, SHINGLE, ROWS = 12, 5, 2

BRACKETS = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
WORD = re.compile(r"[^\W_]+")
#: Odd multipliers of the polynomial and the mixing steps (fixed values).
BASE, MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if "(" in text or "[" in text:
        while True:
            text, n = BRACKETS.subn(" ", text)
            if not n:
                break
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text
        text = unicodedata.normalize("NFKD", text.casefold())
    else:
        text = text.lower()
    return WORD.findall(text)


class Hasher:
    """Words to 64-bit numbers, the same in every process."""

    def __init__(self):
        import xxhash

        self.digest = xxhash.xxh3_64_intdigest
        self.known: dict[str, int] = {}

    def numbers(self, ws: list[str]) -> np.ndarray:
        known, digest = self.known, self.digest
        if len(known) > 1_000_000:
            known.clear()
        out = []
        for w in ws:
            h = known.get(w)
            if h is None:
                h = known[w] = digest(w)
            out.append(h)
        return np.array(out, np.uint64)


def jaccard(containment: float, query: int, upper: int) -> float:
    """Jaccard similarity that ``query`` shingles contained to that part in a
    set of at most ``upper`` have at least."""
    return containment / (upper / query + 1 - containment)


def signatures(numbers: np.ndarray, run: int = RUN, shingle: int = SHINGLE, rows: int = ROWS) -> np.ndarray:
    """Signature of each run of words: ``rows`` MinHash values over its
    shingles, in one number."""
    n = len(numbers)
    if n < run:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n - shingle + 1, np.uint64)
        for i in range(shingle):
            h = h * np.uint64(BASE) + numbers[i : n - shingle + 1 + i]
        out = np.zeros(n - run + 1, np.uint64)
        for _ in range(rows):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(MIX)
            h ^= h >> np.uint64(32)
            low = np.lib.stride_tricks.sliding_window_view(h, run - shingle + 1).min(1)
            out = (out ^ low) * np.uint64(BASE)
    return out


def runs_of(ws: list[str], run: int) -> set:
    return {tuple(ws[i : i + run]) for i in range(len(ws) - run + 1)}


def signed(texts: DataFrame, run: int = RUN, shingle: int = SHINGLE, rows: int = ROWS) -> DataFrame:
    """``(id, signature)`` of the texts ``(id, text)``; once a text, unless it
    is very long."""

    def scan(batches):
        hasher = Hasher()
        for b in batches:
            ids, found, held = [], [], 0
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if key is None or not text:
                    continue
                got = np.unique(signatures(hasher.numbers(words(text)), run, shingle, rows))
                ids.append(np.full(len(got), key, np.int64))
                found.append(got)
                held += len(got)
                if held > 1 << 17:
                    yield _two(ids, found)
                    ids, found, held = [], [], 0
            yield _two(ids, found)

    return texts.mapInArrow(scan, "id bigint, signature bigint")


def _two(ids: list, found: list) -> pa.RecordBatch:
    i = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    h = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return pa.record_batch([pa.array(i), pa.array(h.view(np.int64))], names=["id", "signature"])


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, item_id, runs)``: how many different runs of the item the
    document has. A document and item under the same ids in several rows count
    with the row that has most."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).where("id IS NOT NULL AND text <> ''")
    asked = items.select(F.col("item_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).where("id IS NOT NULL AND text <> ''")
    keys = written(signed(asked, run, shingle).distinct(), "signatures").withColumnRenamed("id", "item_id")
    pairs = signed(docs, run, shingle).join(keys, "signature").select(F.col("id").alias("doc_id"), "item_id").distinct()
    pairs = written(pairs, "candidates")
    # with the pairs first, so that no other document's text travels where they are few
    both = docs.select(F.col("id").alias("doc_id"), "text").join(pairs, "doc_id").join(asked.select(F.col("id").alias("item_id"), F.col("text").alias("item")), "item_id")

    def verify(batches):
        # a document's rows mostly follow each other; so few items are asked for that theirs are kept
        last, have, known = None, set(), {}
        for b in batches:
            docs, found, counts = [], [], []
            for doc, item, passage, text in zip(*(b.column(k).to_pylist() for k in range(4))):
                if text != last:
                    last, have = text, runs_of(words(text), run)
                if passage not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[passage] = runs_of(words(passage), run)
                n = len(known[passage] & have)
                if n:
                    docs.append(doc)
                    found.append(item)
                    counts.append(n)
            yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(found, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "item_id", "runs"])

    sure = both.select("doc_id", "item_id", "item", "text").mapInArrow(verify, "doc_id bigint, item_id bigint, runs bigint")
    return sure.groupBy("doc_id", "item_id").agg(F.max("runs").alias("runs"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked item: documents that contain some of it, and the largest
    number of its runs in one of them."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("runs").alias("most_runs"))
