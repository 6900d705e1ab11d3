"""Tokens, leaks and spam against other implementations and small fixtures."""

import os
import random
import re
import unicodedata

import numpy as np
import pytest

from ridgevec.llm import leaks, spam, tokenize

VOCABULARY = tokenize.VOCABULARY
JSON = "/opt/tokenizers/byte_bpe_50k.json"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
DOC = "doc_id bigint, text string, ids string, item_id string, h string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DOC).repartition(3)


def odd_texts(n=400, seed=1):
    rng = random.Random(seed)
    ranges = [(0x20, 0x7F), (0xA0, 0x250), (0x370, 0x52F), (0x600, 0x6FF), (0x900, 0x97F), (0x3040, 0x30FF), (0x4E00, 0x4FFF), (0x1F300, 0x1F64F), (0x300, 0x36F), (0x2000, 0x206F)]
    out = ["", " ", "\n\n  \t", "a" * 5000, " " * 3000, "ab" * 4000, "é" * 700, "😀" * 300, "don't WE'LL it's", "<|endoftext|>", "﻿x­‍y", "1234567890" * 50, "!?" * 500]
    for _ in range(n):
        part = []
        for _ in range(rng.randrange(1, 40)):
            lo, hi = rng.choice(ranges)
            part.append("".join(chr(rng.randrange(lo, hi)) for _ in range(rng.randrange(1, 9))))
        out.append(rng.choice(["", " ", "\n", "  "]).join(part))
    return out


@needs_vocabulary
def test_ids_equal_a_public_implementation():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    enc = tokenize.Encoder(open(VOCABULARY, "rb").read())
    texts = odd_texts()
    for text, want in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert enc.encode(text) == want.ids
        assert "".join(tokenize.decode_stream(enc.encode(text), enc.fst.tokens)) == text


@needs_vocabulary
def test_memos_may_be_emptied(monkeypatch):
    data = open(VOCABULARY, "rb").read()
    want = [tokenize.Encoder(data).encode(t) for t in odd_texts(60)]
    monkeypatch.setattr(tokenize, "MEMO", 50)
    enc = tokenize.Encoder(data)
    assert [enc.encode(t) for t in odd_texts(60)] == want


def merged(ranks, piece):
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 10**9), i) for i in range(len(parts) - 1))
        if rank == 10**9:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return tuple(ranks[p] for p in parts)


def test_transducer_equals_merging_on_learned_vocabularies():
    rng = random.Random(3)
    for trial in range(6):
        text = [bytes(rng.choice(b"ab" if trial % 2 else b"abc") for _ in range(rng.randrange(2, 30))) for _ in range(80)]
        ranks = {bytes([b]): b for b in range(256)}
        work = [[bytes([b]) for b in t] for t in text]
        for step in range(40):
            count = {}
            for t in work:
                for p in zip(t, t[1:]):
                    count[p] = count.get(p, 0) + 1
            if not count:
                break
            best = max(count, key=lambda p: (count[p], p))
            if best[0] + best[1] in ranks:
                break
            ranks[best[0] + best[1]] = 256 + step
            for t in work:
                i = 0
                while i < len(t) - 1:
                    if (t[i], t[i + 1]) == best:
                        t[i : i + 2] = [t[i] + t[i + 1]]
                    i += 1
        fst = tokenize.Transducer(ranks)
        for _ in range(300):
            piece = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(0, 60)))
            assert fst.encode_piece(piece) == merged(ranks, piece)


def test_utf8_machine_equals_the_decoder():
    rng = random.Random(4)
    tokens = {i: bytes([i]) for i in range(256)}
    for _ in range(2000):
        raw = bytes(rng.choice([rng.randrange(256), 0x61, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0]) for _ in range(rng.randrange(0, 12)))
        assert "".join(tokenize.decode_stream(raw, tokens)) == raw.decode("utf-8", "replace")


@needs_vocabulary
def test_encoding_rows(spark):
    rows = [(1, "Hello world"), (2, ""), (3, None), (None, "x"), (4, "Hello world"), (4, "Hello world"), (5, "word " * 40000)]
    got = tokenize.encoded(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: list(r["ids"]) for r in got}
    assert by[2] == by[3] == [] and by[1] == by[4] and len(by[5]) >= 40000
    assert tokenize.encoded(docs(spark, [])).count() == 0
    back = {r["doc_id"]: r["text"] for r in tokenize.decoded(tokenize.encoded(docs(spark, rows))).collect()}
    assert back[1] == "Hello world" and back[3] == ""


# -- leaks --------------------------------------------------------------------


def simple_words(t):
    t = re.sub(r"\([^()]*\)|\[[^\[\]]*\]", " ", t or "")
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).casefold()
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFKD", t))


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    vocab = ["été", "Straße", "ﬁne", "don't", "x1", *[f"w{i}" for i in range(40)]]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randrange(5, 60))) for i in range(30)] + [(90, None), (91, ""), (None, text(30)), (92, text(12)), (92, text(13))]
    rows = [(i, text(rng.randrange(0, 90))) for i in range(60)]
    for i in range(60, 120):
        w = (rng.choice(items[:30])[1]).split(" ")
        k = rng.randrange(0, max(1, len(w) - 14))
        cut = w[k : k + rng.randrange(9, 16)]
        cut.insert(rng.randrange(len(cut)), rng.choice(["(some noise here)", "[x]", "--", "(a (b) c)"]))
        rows.append((i, text(20) + " " + " ".join(cut).upper() + "\n" + text(5)))
    rows += [(200, None), (201, ""), (202, "  "), (None, items[0][1]), (203, " ".join(t or "" for _, t in items) * 30), rows[70], rows[70]]
    # nested brackets fall away from the inside out
    want = set()
    for d, t in rows:
        while t and re.search(r"\([^()]*\)|\[[^\[\]]*\]", t):
            t = re.sub(r"\([^()]*\)|\[[^\[\]]*\]", " ", t)
        dw = simple_words(t)
        have = {tuple(dw[i : i + 12]) for i in range(len(dw) - 11)}
        for i, u in items:
            iw = simple_words(u)
            if d is not None and i is not None and any(tuple(iw[k : k + 12]) in have for k in range(len(iw) - 11)):
                want.add((d, i))
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id bigint, text string, lang string, doc_id int")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for size in (limit, "-1"):  # signatures joined by broadcast and by shuffle
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
        try:
            got = [(r["doc_id"], r["item_id"]) for r in leaks.leaks(docs(spark, rows), table).collect()]
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        assert set(got) == want and len(got) == len(set(got))
    assert leaks.leaks(docs(spark, []), table).count() == 0
    assert leaks.leaks(docs(spark, rows), table.limit(0)).count() == 0


def test_equal_runs_have_equal_signatures():
    h = leaks.Hasher()
    a, b = "a b c d e f g h i j k l m n".split(), "z z a b c d e f g h i j k l y".split()
    assert leaks.signatures(h.numbers(a))[0] in leaks.signatures(h.numbers(b))
    assert len(leaks.signatures(h.numbers(a[:11]))) == 0
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 500, 5000).astype(np.uint64)
    # neighbours mostly share a signature
    assert len(np.unique(leaks.signatures(ids))) < 0.6 * 4989


def test_containment_as_jaccard():
    assert leaks.jaccard(1.0, 8, 8) == 1.0
    assert abs(leaks.jaccard(0.5, 10, 40) - 5 / 45) < 1e-12


# -- spam ---------------------------------------------------------------------


def corpus(seed=6):
    rng = random.Random(seed)
    nouns, verbs = [f"noun{i}" for i in range(30)], [f"verb{i}" for i in range(20)]
    say = lambda: rng.choice(["The committee wants to {v} the {n} in {p}.", "Nobody believes that the {n} is {v}.", "We must {v} the {n} before it closes."]).format(v=rng.choice(verbs), n=rng.choice(nouns), p=f"Place{rng.randrange(400)}")
    speech = lambda k: " ".join(say() for _ in range(k))
    keys = lambda n: [f"key{rng.randrange(10**6)}" for _ in range(n)]
    rows = [(i, ("The sitting is open. " if i % 9 == 0 else "") + speech(rng.randrange(3, 12))) for i in range(600)]
    bad = []
    for i in range(1000, 1010):
        k = keys(5)  # every page has keywords of its own
        bad.append((i, speech(2) + "\n" + " ".join(rng.choice(k) for _ in range(150))))
        k = keys(5)
        bad.append((i + 20, ", ".join(rng.choice(k) for _ in range(80)) + ". " + speech(1)))
        bad.append((i + 40, "\n".join(f"Report of noun{rng.randrange(30)} - https://h{j}.example/a/b{j}?id={j}" for j in range(20))))
        k = keys(5)
        bad.append((i + 60, " ".join("#" + rng.choice(k) for _ in range(90))))
        bad.append((i + 80, " | ".join(rng.choice(["Home", "Next", "Archive", "Motion on noun1"]) for _ in range(50))))
    good = [(2000, speech(3) + "\nAyes 30: " + ", ".join(f"Name{rng.randrange(10**6)}" for _ in range(30)) + ". " + speech(3)), (2001, speech(12) + " See https://h.example/a and https://h.example/b."), (2002, "The sitting is open. " * 30), (2003, "\n".join(f"{j}. Report of noun{j}. " + say() for j in range(8)))]
    return rows, bad, good


def test_spam_on_a_small_corpus(spark):
    rows, bad, good = corpus()
    odd = [(3000, None), (3001, ""), (3002, "  \n"), (3003, "one two"), (None, "x y z"), (3004, "é" * 50000)]
    every = docs(spark, rows + bad + good + odd + bad[:3])
    found = [r["doc_id"] for r in spam.scores(every).where("share > 0.5").select("doc_id").distinct().collect()]
    assert set(found) == {i for i, _ in bad}
    assert spam.scores(every).count() == len(rows + bad + good + odd) - 1 + 3


def test_spam_on_nothing(spark):
    assert spam.scores(docs(spark, [])).count() == 0
    assert spam.scores(docs(spark, [(1, None)])).first()["share"] == 0.0


def test_spam_counts_are_over_documents(spark):
    s = spam.statistics(docs(spark, [(1, "a b a b a b"), (2, "a b c"), (3, "a b")]))
    assert s.docs == 3 and s.pair_docs.tolist() == [3] and sorted(s.word_docs.tolist()) == [3, 3]


def test_cases_are_suspect_by_their_mean_pmi(spark, monkeypatch):
    """Without any look at forms, keyword pages and lists come out as suspect,
    and a division list doesn't."""
    rows, bad, good = corpus()
    good = [*good, (2010, "The sitting is open. Ayes 150: " + ", ".join(f"Name{7 * i} Other{i}" for i in range(150)))]
    monkeypatch.setattr(spam, "marks", lambda text, n: None)
    part = {r["doc_id"]: r["incoherent"] for r in spam.scores(docs(spark, rows + bad + good)).collect()}
    assert all(part[i] > spam.CASE for i, _ in bad)
    assert part[2010] <= spam.CASE
    # speech with more words to it: each is followed by one of three
    rng = random.Random(8)
    after = {i: [rng.randrange(900) for _ in range(3)] for i in range(900)}

    def talk(n, at):
        out = []
        for _ in range(n):
            out.append(f"say{at}")
            at = rng.choice(after[at])
        return " ".join(out) + "."

    plain = [(i, talk(160, rng.randrange(900))) for i in range(300)]
    part = {r["doc_id"]: r["incoherent"] for r in spam.scores(docs(spark, plain + bad)).collect()}
    assert all(part[i] > spam.CASE for i, _ in bad)
    assert sum(part[i] > spam.CASE for i, _ in plain) <= 0.05 * len(plain)


def found(df):
    return {r["doc_id"] for r in df.where("share > 0.5").select("doc_id").distinct().collect()}


def test_copies_of_spam_do_not_vouch_for_it(spark):
    rows, _, good = corpus()
    rng = random.Random(12)
    # too many words for the page itself to look crowded
    keys = [f"stuff{i}" for i in range(50)]
    page = " ".join(rng.choice(keys) for _ in range(220))
    copies = [(5000 + i, page) for i in range(300)] + [(5300, page.upper()), (5301, page.replace(" ", "  ", 9))]
    assert not spam.crowded(page, *spam.Words().of(page)).any()
    assert found(spam.scores(docs(spark, rows + good + copies))) == {i for i, _ in copies}


def test_pages_that_share_keywords_do_not_vouch_for_each_other(spark):
    rows, _, good = corpus()
    rng = random.Random(13)
    keys = [f"stuff{i}" for i in range(6)]
    salad = [(5000 + i, rows[i][1][:80] + "\n" + " ".join(rng.choice(keys) for _ in range(150))) for i in range(40)]
    ended = [(5100 + i, " ".join(" ".join(rng.choice(keys) for _ in range(rng.randrange(2, 6))) + "." for _ in range(40))) for i in range(40)]
    phrase = [(5200 + i, f"Page {i}. " + "cheap harbour loans today " * 30) for i in range(40)]
    fine = [(6000 + i, " ".join(f"Member name{i * 40 + j} voted aye." for j in range(40))) for i in range(5)]
    fine += [(6100 + i, "\n".join(f"Amendment {j} of clause {i} rejected" + "." * (j % 2) for j in range(40))) for i in range(5)]
    every = docs(spark, rows + good + salad + ended + phrase + fine)
    assert found(spam.scores(every)) == {i for i, _ in salad + ended + phrase}


def test_rare_pairs_count_too(spark):
    """With next to nothing in the driver's table the figures are the same."""
    rows, bad, good = corpus()
    every = docs(spark, rows + bad + good + bad[:3] + [(3000, None), (3001, "")])
    take = lambda **kw: sorted((r["doc_id"], r["share"], r["incoherent"], r["mean_pmi"]) for r in spam.scores(every, **kw).collect())
    want = take(rare=0.0)
    assert take(rare=2e-3) == want
    cases = {i for i, share, *_ in want if share > spam.CASE}
    assert {i for i, share, *_ in take(rare=2e-3, above=spam.CASE) if share > spam.CASE} == cases == {i for i, _ in bad}
