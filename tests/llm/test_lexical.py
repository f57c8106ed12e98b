"""BPE, ranked search and the divergence audit: brute force, round trips and odd rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from clearsky.llm import bpe, divergence, ranked_search
from llm.test_operators import ROWS, SCHEMA

WORDS = public_tokenizers.path("word_bpe_49k.json")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, g, s, 0, 1, "x", "y") for i, t, g, s in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_equals_the_library():
    words, library = bpe.vocabulary(WORDS), Tokenizer.from_file(WORDS)
    rng = random.Random(3)
    letters = "abcdeth'ſßİΣςéñ<|>startoftext endoftext012४五😀́  \t\n.,;-'s'll'RE\x00"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice((rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF)))) for _ in range(30))
              for _ in range(500)]
    texts += ["<|endoftext|>a<|startoftext|>", " <|endoftext|> <|ENDOFTEXT|>", "ΑΣ ΟΔΟΣ", "a" * 257, "the" * 400, "é" * 300]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert words.encode(text) == want, text
        assert words.decode(want) == library.decode(want, skip_special_tokens=False), text


def test_short_and_long_words_merge_alike():
    words, rng = bpe.vocabulary(WORDS), random.Random(4)
    for _ in range(300):
        word = "".join(rng.choices("theinganrs", k=rng.randint(1, 90)))
        assert bpe.merged(word, words.suffix, words.ranks) == bpe.merged_long(word, words.suffix, words.ranks)


def test_bpe_on_odd_rows(spark, odd, none):
    library = Tokenizer.from_file(WORDS)
    rows = bpe.decode(bpe.encode(odd, WORDS), WORDS).collect()
    want = [library.encode(t or "", add_special_tokens=False).ids for _, t, _, _ in ROWS]
    assert sorted((repr(r.doc_id), r.ids, r.decoded) for r in rows) == sorted(
        (repr(i), ids, library.decode(ids, skip_special_tokens=False)) for (i, *_), ids in zip(ROWS, want, strict=True)
    )
    assert bpe.digests(none, WORDS).count() == 0


def brute_search(rows, items, top=10):
    """[(item, rank, doc_id, score)] from plain counting."""
    counts = [(i, Counter(TERM.findall((t or "").translate(UPPER)))) for i, t in rows]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = 0
            for term in set(TERM.findall((text or "").translate(UPPER))):
                if c[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += w * (10**9 * c[term] // (1000 * c[term] + 8 * m))
            if score:
                found.append((-score, doc is None, doc or 0, doc))
        for k, (score, _, _, doc) in enumerate(sorted(found)[:top]):
            out.append((item, k + 1, doc, -score))
    return out


def test_search_equals_brute_force_with_ties_and_copies(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)] + ["Ünï", "七"]
    texts = [" ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(62)], k=rng.randint(0, 40)))
             for _ in range(400)]
    texts += [texts[7]] * 150 + [None, "", "...", "W3,w3;W3 ünï"]
    rows = [(k if k % 50 else None, t) for k, t in enumerate(texts)] + [(3, texts[3])]
    items = [(k // 2, " ".join(rng.sample(vocabulary, 6))) for k in range(20)] + [(None, "w1 w1 w2"), (99, "zz"), (98, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    wanted = spark.createDataFrame(items, "item_id int, text string")
    assert as_rows(ranked_search.search(docs, wanted)) == by_item(brute_search(rows, items))
    monkeypatch.setattr(ranked_search, "ITEMS", 5)  # several groups of items
    assert as_rows(ranked_search.search(docs, wanted)) == by_item(brute_search(rows, items))


def by_item(rows):
    return sorted(rows, key=repr)


def as_rows(df):
    return by_item([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()])


def test_bounds_hold_and_leave_documents_out(spark):
    rng = random.Random(6)
    items = [(k, " ".join(f"t{rng.randint(0, 300)}" for _ in range(12))) for k in range(30)]
    texts = [" ".join(f"t{int(rng.paretovariate(0.6)) % 301}" for _ in range(60)) for _ in range(3000)] + [t for _, t in items] * 12
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ranked_search.search(docs, spark.createDataFrame(items, "item_id int, text string"))
    assert as_rows(got) == by_item(brute_search(rows, items))


def test_search_on_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "quick Brown idiot"), (2, None)], "item_id long, text string")
    want = brute_search([(i, t) for i, t, _, _ in ROWS], [(1, "quick Brown idiot"), (2, None)])
    assert as_rows(ranked_search.search(odd, items)) == by_item(want)
    assert ranked_search.search(none, items).count() == 0
    assert ranked_search.search(odd, items.where("item_id > 9")).count() == 0


LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_audit(rows, top=200, min_docs=3):
    """[(lang, source, part, item, value, rank)] from plain counting with Python's integers."""
    counts, holders = defaultdict(Counter), defaultdict(set)
    for r, (lang, source, text) in enumerate(rows):
        terms = LETTERS.findall((text or "").translate(UPPER))
        counts[lang or "", source or ""].update(terms)
        for term in terms:
            holders[lang or "", term].add(r)
    out = []
    share = lambda n, total, v: 1 + 10**9 * (n + 1) // (total + v)
    for lang in {k for k, _ in counts}:
        kept = sorted(t for (k, t), r in holders.items() if k == lang and len(r) >= min_docs)
        of = {s: {t: c[t] for t in kept} for (k, s), c in counts.items() if k == lang}
        p = {s: {t: share(c[t], sum(c.values()), len(kept)) for t in kept} for s, c in of.items()}
        whole = {t: sum(c[t] for c in of.values()) for t in kept}
        q = {t: share(n, sum(whole.values()), len(kept)) for t, n in whole.items()}
        for a in of:
            pairs = [(-sum((p[a][t] - p[b][t]) ** 2 // p[b][t] for t in kept), b) for b in of if b != a]
            more = [(-((p[a][t] - q[t]) ** 2 // q[t]), t) for t in kept if of[a][t] and p[a][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(more)[:top])):
                out += [(lang, a, part, item, -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def audited(df):
    return sorted(tuple(r) for r in df.collect())


def test_divergence_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 3000)  # many slices, and passes that end amid a key
    monkeypatch.setattr(divergence, "ROWS_IN", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    rng = random.Random(7)
    words = [f"{a}{b}{end}" for a in ("ba", "Ko", "ñu", "été") for b in ("", "lo", "-lo", "'s") for end in ("", ",", "!", "9x", "\xa0q")]
    blanks = [" ", "  ", "\t", "\n", "\x0b", "\x0c", "\r\n", "\x1c"]
    rows = []
    for _ in range(600):
        lang = rng.choices(["en", "de", None, "x"], [6, 3, 1, 0.05])[0]
        text = "".join(w + rng.choice(blanks) for w in rng.choices(words, [1 / (k + 1) ** 2 for k in range(len(words))], k=rng.randint(0, 12)))
        rows.append((lang, rng.choice(["a", "b", "c", None, "z" * 30]), rng.choice([text, text, text, None])))
    rows += [("lone", "a", "once only words"), ("lone", "b", ""), ("dup", "a", "same same"), ("dup", "b", "same"), ("dup", "b", "same")]
    rows += [("en", "a", "KO-lo baba ba ba")] * 50
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert audited(divergence.audit(docs)) == brute_audit(rows)
    assert audited(divergence.audit(docs, top=3, min_docs=8)) == brute_audit(rows, 3, 8)
    assert audited(divergence.audit(docs, min_docs=1)) == brute_audit(rows, 200, 1)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_shares_are_exact_for_large_counts():
    rng = random.Random(8)
    for _ in range(500):
        total, kept = rng.randint(0, 8 * 10**15), rng.randint(1, 10**6)
        n = rng.randint(0, total)
        assert divergence.shares(np.array([n]), total, kept)[0] == 1 + 10**9 * (n + 1) // (total + kept)


def test_divergence_on_odd_rows(spark, odd, none):
    rows = [(g, s, t) for _, t, g, s in ROWS]
    assert audited(divergence.audit(odd)) == brute_audit(rows)
    assert divergence.audit(none).count() == 0
