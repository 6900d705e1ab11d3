"""Problem 8: pages of stuffed keywords, links and product tags.

Coherence is the pointwise mutual information (PMI) of neighbouring words from
document counts of the whole corpus; texts of the same words count once and a
document's own occurrence is taken out, so neither a page nor its copies can
vouch for it. PMI above zero counts as zero: nothing makes up for salad beside it.
A word of a collocation (with a neighbour or the next but one) that the page
repeats (``REPEATS`` times, once less in a page of up to ``SHORT`` words) counts
as unattested, whoever else has it: markup,
addresses and menu entries are coherent elsewhere, but speech doesn't repeat
itself so. The mean is taken over a window of ``REACH`` words to each side. A
word is incoherent where it is at most ``INCOHERENT`` and words that come back
make up ``RECURRING`` of the window; names in a division list fit no neighbour,
but don't come back. A page is suspect if more than half of its words are
incoherent, and no other page can be a case. On the 100,000 documents that the
settings were last chosen on, all 3,997 pages that the check alone finds are
suspect, by 0.65 of their words at least; of 30,000 of them 41 % of the other
pages are.

Suspect pages are then checked word by word. A word that fits neither neighbour
and keeps coming back in such places is a stuffed keyword. Different pages with
the same keywords vouch for each other, so words that crowd a stretch of
``CROWD`` words are stuffed whatever their PMI, if they stand in ever other order
or without any punctuation; a formula keeps its order. Words inside links,
markup anchors, bare addresses and hash tags, and entries of lists (short pieces
between separators, in long runs or repeated, without the end of a sentence)
count as well. The share of such words is smoothed over a window of ``REACH``
words to each side; a page is a case if more than half of its words lie where
the share is at least ``DENSE``.

Pairs are attested by ``LEAST_DOCS`` other documents, whatever the corpus. Those
in at least a part ``RARE`` of all distinct pairs of documents, at most
``1 / RARE``, travel with the tasks. Without the rarer ones a page's share can
only be too high, so their counts are joined to the pages that this matters for.

Null, blank and very short texts are no cases; repeated rows give one row.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgevec.session import table, written

RARE, LEAST_DOCS = 1.5e-6, 2
UNATTESTED, UNFIT = -6.0, -1.0
REPEATS, REACH, DENSE, CASE = 3, 8, 0.3, 0.5
INCOHERENT, RECURRING, SHORT = -2.75, 0.2, 120
ENTRY_WORDS, RUN = 8, 5
#: Words of a stretch and of the shortest one, the part of them that words coming
#: back must make up, and the distinct pairs there of each such word.
CROWD, LEAST_CROWD, CROWDED, MIXED = 80, 30, 0.6, 2.0

WORD = re.compile(r"[^\W_]+")
#: What every link has, for a quick look.
LINKISH = re.compile(r"://|www\.|<a\b|\]\(|#\w|\.[a-z]{2,12}/", re.I)
#: Lengths are bounded, so that no text makes a search start over and over.
LINK = re.compile(
    r"<a\b[^>]{0,2000}>[^<]{0,2000}</a>"
    r"|\[[^\]\n]{0,500}\]\([^)\s]{0,2000}\)"
    r"|(?:https?://|www\.)\S+"
    r"|\b[\w-]{1,63}(?:\.[\w-]{1,63}){0,8}\.[a-z]{2,12}/\S*"
    r"|\B#\w+",
    re.I,
)
PIECE = re.compile(r"[\n|»›•·*;,/\t]+| [-–—] ")
ENTRY = re.compile(r"[\n|»›•·]+")
MARK = re.compile(r"[^\w\s]")
ENDS = (".", "!", "?", ":", "…")
MIX = 0x9E3779B97F4A7C15


class Hashes(dict):
    """64-bit word hashes that agree between processes, made when missing."""

    def __init__(self):
        import xxhash

        super().__init__()
        self.digest = xxhash.xxh3_64_intdigest

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = self.digest(word)
        return h


class Words:
    def __init__(self):
        self.known = Hashes()

    def of(self, text: str) -> tuple[list[str], np.ndarray]:
        low = text.lower()
        # a few letters grow when lowered, which may cut words in two
        words = WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]
        return words, np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def pairs(h: np.ndarray) -> np.ndarray:
    return joined(h[:-1], h[1:])


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a * np.uint64(MIX)) ^ (b + np.uint64(0x632BE59BD9B4E019))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(MIX)
        return x ^ (x >> np.uint64(29))


def _count(batches):
    reader = Words()
    for b in batches:
        single, double, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], 0
        for text in b.column(0).to_pylist():
            if not text:
                continue
            docs += 1
            _, h = reader.of(text)
            single.append(np.unique(h))
            double.append(np.unique(pairs(h)))
        yield pa.record_batch([pa.array([None], pa.bool_()), pa.array([0], pa.int64()), pa.array([docs], pa.int64())], names=["pair", "h", "c"])
        for pair, part in ((False, single), (True, double)):
            h, c = np.unique(np.concatenate(part), return_counts=True)
            yield pa.record_batch([pa.array(np.full(len(h), pair)), pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["pair", "h", "c"])


class Statistics:
    """Document counts of the words and pairs in at least ``least`` documents."""

    def __init__(self, docs: int, least: float, words, word_docs, pair_hashes, pair_docs):
        self.docs, self.least = docs, least
        #: Attested pairs may be missing.
        self.partial = math.ceil(least) > LEAST_DOCS + 1
        self.words, self.word_docs = words, word_docs
        self.pairs, self.pair_docs = pair_hashes, pair_docs

    @staticmethod
    def _look(keys, values, h):
        if not len(keys) or not len(h):
            return np.zeros(len(h))
        at = np.searchsorted(keys, h)
        at[at == len(keys)] = 0
        return np.where(keys[at] == h, values[at], 0).astype(np.float64)

    def rare(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and pairs of a text whose counts aren't here."""
        double = pairs(h)
        gone = self._look(self.pairs, self.pair_docs, double) == 0
        single = np.concatenate([h[:-1][gone], h[1:][gone]])
        return np.unique(single[self._look(self.words, self.word_docs, single) == 0]), np.unique(double[gone])

    def pmi(self, h: np.ndarray, more: Statistics | None = None) -> np.ndarray:
        """Of each pair of neighbours, without the document's own part;
        ``more`` has the counts of a text's rare words and pairs."""
        both = self._look(self.pairs, self.pair_docs, pairs(h)) - 1
        one = self._look(self.words, self.word_docs, h)
        if more is not None:
            both += more._look(more.pairs, more.pair_docs, pairs(h))
            one += more._look(more.words, more.word_docs, h)
        one = np.maximum(1, one)
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.log(both * self.docs / (one[:-1] * one[1:]))
        return np.where(both >= LEAST_DOCS, value, UNATTESTED)


def statistics(documents: DataFrame, rare: float = RARE) -> Statistics:
    return all_counts(documents, rare)[0]


def _sorted(docs: int, least: float, pair: np.ndarray, h: np.ndarray, c: np.ndarray) -> Statistics:
    w, q = np.flatnonzero(~pair), np.flatnonzero(pair)
    w, q = w[np.argsort(h[w])], q[np.argsort(h[q])]
    return Statistics(docs, least, h[w], c[w], h[q], c[q])


def all_counts(documents: DataFrame, rare: float = RARE) -> tuple[Statistics, DataFrame]:
    """Counts over all distinct texts, whatever stands between the words and in
    which case, as the written table ``(pair, h, c)`` and what isn't rare of
    it. Partial counts are folded in the tasks, then by hash, and at most
    ``1 / rare`` pairs reach the driver, and no more words than that and the
    documents' first words."""
    texts = documents.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL AND text <> ''")
    spoken = F.trim(F.regexp_replace(F.lower("text"), r"(?U)[\W_]+", " "))
    texts = texts.groupBy(F.md5(spoken.cast("binary")).alias("key")).agg(F.min("text").alias("text")).select("text")
    counts = texts.mapInArrow(_count, "pair boolean, h bigint, c bigint").groupBy("pair", "h").agg(F.sum("c").alias("c"))
    counts = written(counts, "pairs")
    r = counts.agg(F.sum(F.when(F.col("pair"), F.col("c"))).alias("pairs"), F.sum(F.when(F.col("pair").isNull(), F.col("c"))).alias("docs")).first()
    total = r["pairs"] or 0
    least = max(float(LEAST_DOCS), total * rare)
    kept = counts.where(F.col("pair").isNotNull() & (F.col("c") >= math.ceil(least))).toArrow()
    h, c, p = kept["h"].to_numpy().view(np.uint64), kept["c"].to_numpy(), kept["pair"].to_numpy(zero_copy_only=False).astype(bool)
    return _sorted(r["docs"] or 0, least, p, h, c), counts


def _in_spans(starts: np.ndarray, spans) -> np.ndarray:
    """Index of the span each word starts in."""
    return np.minimum(np.searchsorted(np.array([e for _, e in spans]), starts, side="right"), len(spans) - 1)


def _spans(text: str, cut: re.Pattern):
    at, spans = 0, []
    for m in cut.finditer(text):
        spans.append((at, m.start()))
        at = m.end()
    spans.append((at, len(text)))
    return spans


def _repeated(text: str):
    """Pieces that come back and don't end like a sentence, and their spans."""
    pieces = PIECE.split(text)
    if len(pieces) < REPEATS:
        return None
    keys = [k.strip().lower() for k in pieces]
    often = {k for k, c in Counter(keys).items() if c >= REPEATS and k and len(k) < 60 and not k.endswith(ENDS[:3])}
    return np.array([k in often for k in keys]) if often else None


def _listed(text: str):
    """Long runs of short pieces. Pieces cut by line ends alone must begin
    like an entry, with a capital or a figure."""
    if len(ENTRY.findall(text)) < RUN - 1:
        return None
    entries = _spans(text, ENTRY)
    listed, run = np.zeros(len(entries), bool), []
    for i, (a, b) in enumerate([*entries, (0, 0)]):
        piece = text[a:b].strip() if i < len(entries) else "."
        if not piece:
            continue
        by_line = (a == 0 or text[a - 1] == "\n") and (b == len(text) or text[b] == "\n")
        fits = not piece.endswith(ENDS) and len(WORD.findall(piece)) <= ENTRY_WORDS and not (by_line and piece[0].islower())
        if fits and WORD.search(piece):
            run.append(i)
        elif not fits:
            if len(run) >= RUN:
                listed[run] = True
            run = []
    return (entries, listed) if listed.any() else None


def marks(text: str, n: int) -> np.ndarray | None:
    """``(2, n)``: words inside links, and words of list entries; None where
    there is neither."""
    linked = [m.span() for m in LINK.finditer(text)] if LINKISH.search(text) else []
    again, listed = _repeated(text), _listed(text)
    if not linked and again is None and listed is None:
        return None
    starts = np.fromiter((m.start() for m in WORD.finditer(text)), np.int64, n)
    out = np.zeros((2, n), bool)
    for a, b in linked:
        out[0, np.searchsorted(starts, a) : np.searchsorted(starts, b)] = True
    if again is not None:
        out[1] |= again[_in_spans(starts, _spans(text, PIECE))]
    if listed is not None:
        out[1] |= listed[1][_in_spans(starts, listed[0])]
    return out


def crowded(text: str, words: list[str], h: np.ndarray) -> np.ndarray:
    """Words that come back all over a stretch: not in the fixed order of a
    formula or list, or in any order without a mark between them."""
    n = len(h)
    out, starts = np.zeros(n, bool), None
    if n < LEAST_CROWD:
        return out
    for s in range(0, max(1, n - CROWD // 2), CROWD // 2):
        s = max(0, min(s, n - CROWD))
        if 2 * len(set(words[s : s + CROWD])) > min(n, CROWD):
            continue
        _, which, count = np.unique(h[s : s + CROWD], return_inverse=True, return_counts=True)
        back = count[which] >= REPEATS
        if back.mean() < CROWDED:
            continue
        both = back[:-1] & back[1:]
        mixed = len(np.unique(which[:-1][both] * len(count) + which[1:][both])) >= MIXED * (count >= REPEATS).sum()
        if not mixed:
            if starts is None:
                starts = [m.start() for m in WORD.finditer(text)]
            piece = text[starts[s] : starts[min(n, s + CROWD) - 1]]
            mixed = "\n" not in piece and not MARK.search(piece)
        if mixed:
            out[s : s + CROWD] |= back
    return out


def smoothed(x: np.ndarray) -> np.ndarray:
    """Means over ``REACH`` values to each side."""
    total = np.concatenate([[0.0], np.cumsum(x)])
    at = np.arange(len(x))
    low, high = np.maximum(0, at - REACH), np.minimum(len(x), at + REACH + 1)
    return (total[high] - total[low]) / (high - low)


def often(keys: np.ndarray, times: int) -> np.ndarray:
    """Which keys come at least so many times."""
    ordered = np.sort(keys)
    back = ordered[times - 1 :]
    back = back[back == ordered[: len(back)]]
    if not len(back):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(back, keys)
    at[at == len(back)] = 0
    return back[at] == keys


def repeats(h: np.ndarray) -> int:
    """Times that something has to come in a text of this length to be repeated."""
    return REPEATS if len(h) > SHORT else REPEATS - 1


def recurring(h: np.ndarray) -> np.ndarray:
    """Words of windows where words come back."""
    return smoothed(often(h, repeats(h))) >= RECURRING


def incoherent(h: np.ndarray, value: np.ndarray, back: np.ndarray) -> float:
    """Part of a text's words in windows of low mean PMI where words come back."""
    padded = np.concatenate([[UNATTESTED], np.minimum(value, 0), [UNATTESTED]])
    word = (padded[:-1] + padded[1:]) / 2
    for gap in (1, 2):
        again = often(joined(h[:-gap], h[gap:]), repeats(h))
        word[:-gap][again] = UNATTESTED
        word[gap:][again] = UNATTESTED
    return float((back & (smoothed(word) <= INCOHERENT)).mean())


def judge(text: str | None, reader: Words, stats: Statistics, more: Statistics | None = None, above: float = -1.0) -> tuple[float, float, float]:
    """Share of a text's words that lie in spam (0 unless the text is suspect),
    of its incoherent words, and the mean PMI of its neighbours (0 for fewer
    than two words). Where so few words come back that the incoherent can't be
    more than ``above``, that bound is given for them, and no PMI."""
    if not text:
        return 0.0, 0.0, 0.0
    words, h = reader.of(text)
    n = len(words)
    if n < REPEATS:
        return 0.0, 0.0, 0.0
    back = recurring(h)
    bound = float(back.mean())
    if bound <= above:
        return 0.0, bound, 0.0
    value = stats.pmi(h, more)
    mean, part = float(value.mean()), incoherent(h, value, back)
    if part <= CASE:
        return 0.0, part, mean
    padded = np.concatenate([[UNATTESTED], value, [UNATTESTED]])
    loose = np.maximum(padded[:-1], padded[1:]) < UNFIT
    both = marks(text, n)
    mark = np.zeros(n, bool)
    if both is not None:
        loose &= ~both[0]
        mark = both[0] | both[1]
    at = np.flatnonzero(loose)
    back = Counter(words[i] for i in at)
    mark[[i for i in at if back[words[i]] >= REPEATS and len(words[i]) > 1]] = True
    mark |= crowded(text, words, h)
    return float((smoothed(mark) >= DENSE).mean()), part, mean


def scores(documents: DataFrame, rare: float = RARE, above: float = -1.0) -> DataFrame:
    """``(doc_id, share, incoherent, mean_pmi)`` of every document with an id.
    Shares up to ``above`` may be too high, but no higher than that; so may the
    incoherent part be there, and the PMI too low."""
    stats, counts = all_counts(documents, rare)

    def first(batches):
        reader = Words()
        for b in batches:
            texts = b.column(1).to_pylist()
            got = [judge(t, reader, stats, above=above) for t in texts]
            # only these need the rare counts as well
            more = [t if stats.partial and t and g[0] > above else None for t, g in zip(texts, got)]
            yield pa.record_batch([b.column(0), *_figures(got), pa.array(more, pa.string())], names=["doc_id", "share", "incoherent", "mean_pmi", "text"])

    def asks(batches):
        reader = Words()
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for pair, h in enumerate(stats.rare(reader.of(text)[1])):
                    yield pa.record_batch([pa.array([key] * len(h), pa.string()), pa.array(np.full(len(h), bool(pair))), pa.array(h.view(np.int64))], names=["key", "pair", "h"])

    def again(batches):
        reader = Words()
        for b in batches:
            got = []
            for text, seen in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                pair, h, c = (np.array([x[k] for x in seen or []], t) for k, t in (("pair", bool), ("h", np.int64), ("c", np.int64)))
                got.append(judge(text, reader, stats, _sorted(stats.docs, 0, pair, h.view(np.uint64), c)))
            yield pa.record_batch([b.column(0), *_figures(got)], names=["key", "share", "incoherent", "mean_pmi"])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    judged = rows.mapInArrow(first, "doc_id bigint, share double, incoherent double, mean_pmi double, text string")
    if not stats.partial:
        return judged.drop("text")
    judged = written(judged.withColumn("key", F.md5(F.col("text").cast("binary"))), "judged")
    pages = judged.where("key IS NOT NULL").groupBy("key").agg(F.min("text").alias("text"))
    pages = written(pages, "pages")
    # a pair has the page itself besides; a word counts from the first
    known = counts.where(F.col("pair").isNotNull() & (F.col("c") < math.ceil(stats.least)) & (~F.col("pair") | (F.col("c") > LEAST_DOCS)))
    seen = pages.mapInArrow(asks, "key string, pair boolean, h bigint").join(known, ["pair", "h"]).groupBy("key").agg(F.collect_list(F.struct("pair", "h", "c")).alias("seen"))
    exact = pages.join(seen, "key", "left").select("key", "text", "seen").mapInArrow(again, "key string, share double, incoherent double, mean_pmi double")
    settled = judged.where("key IS NULL").select("doc_id", "share", "incoherent", "mean_pmi")
    return settled.unionByName(judged.where("key IS NOT NULL").select("doc_id", "key").join(exact, "key").select("doc_id", "share", "incoherent", "mean_pmi"))


def _figures(got: list) -> list[pa.Array]:
    return [pa.array([round(g[k], 6) for g in got], pa.float64()) for k in range(3)]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), above=CASE).where(F.col("share") > CASE).select("doc_id").distinct()


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
