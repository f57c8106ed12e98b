"""Near-duplicate passages by compact windows.

The tokens of a text are its five-word shingles. For each of ``HASHES`` hash functions the
Cartesian tree of the hashed tokens groups all passages of ``least`` tokens or more by their
min-hash: a *compact window* (l, c, r) stands for every passage that begins in l..c, ends in
c..r, and so has the hash of token c as its signature. A text of n tokens has about
2 n / least windows for each hash function; equal minima give the window once for each of their places.

1. Signatures met in more than one document are kept, all others leave before any join.
2. *Interval join* inside a document: windows of two hash functions agree on passages if their
   intersection holds an anchor c of both and ``least`` tokens. What such pairs cover of a text, 2 of
   ``HASHES`` min-hashes that other texts have as well, are its *ranges*: one row a document.
3. Inside the ranges documents meet under *runs*: ``RUN`` tokens, picked by winnowing so that any
   equal stretch of ``RUN + PICK - 1`` tokens has the same run picked in both texts. The smallest
   document of a run is its leader and each other one a candidate against it, linear in the size of
   any group of copies. Texts that share more than the leader has meet under the runs it lacks.
4. Verification: the leader's tokens travel to the other text. A stretch passes if on one diagonal
   ``similarity`` of the aligned tokens are equal, or if an alignment over neighbouring diagonals
   (words put in or left out) has that Jaccard similarity between its own start and end.
5. Runs that lie in no accepted stretch are open. Around them (in every document that has them)
   texts meet under all passages of ``least`` tokens: equal ones are found whatever leads their runs.

Repeated rows of one document do not count as a repetition. The leader of a passage keeps it.

Cases: null and empty texts and texts below ``least`` tokens have no windows; rows without a
``doc_id`` are left out, since a pair of documents needs names; ties go to the smaller id; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clearsky.llm.base import slices
from clearsky.llm.words import hashed, mix, shingles, stretches
from clearsky.session import stored

WORDS = 5
LEAST_WORDS = 50
HASHES = 5
RUN = 8
PICK = 7
BAND = 8
SIMILARITY = 0.8
MATCHES = 1 << 20  # of two texts that are held at once
_SEEDS = [np.uint64(0xA0761D6478BD642F * (j + 1) % (1 << 64)) for j in range(8)]


def tokens(texts: list, k: int = WORDS) -> list[np.ndarray]:
    words, places = hashed(texts)
    grams, _ = shingles(words, places, k)
    return [grams[a : max(a, b - k + 1)] for a, b in zip(places[:-1], places[1:], strict=True)]


def _windows_of(values: np.ndarray, places: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, l, c, r of the compact windows of many texts that begin at ``places`` (one more at the end).

    A value is the minimum of a node that spans ``least`` values if it is that of some ``least`` values
    around it. The next smaller values on both sides, the node's borders, are such minima themselves.
    """
    low, sizes, width = values, np.diff(places), 1
    while width < least:
        step = min(width, least - width)
        low = np.concatenate([np.minimum(low[:-step], low[step:]), low[-step:]])
        width += step
    whole = np.arange(len(values)) + least <= np.repeat(places[1:], sizes)
    high, width = np.where(whole, low, 0), 1
    while width < least:
        step = min(width, least - width)
        high = np.concatenate([high[:step], np.maximum(high[step:], high[:-step])])
        width += step
    c = np.flatnonzero((high == values) & np.repeat(sizes >= least, sizes))
    text = np.searchsorted(places, c, side="right") - 1
    # A zero before and behind each text is smaller than all its values.
    zeros, at = np.searchsorted(c, places) + np.arange(len(places)), np.arange(len(c)) + text + 1
    v, place = np.zeros(len(c) + len(places), dtype=np.uint64), np.zeros(len(c) + len(places), dtype=np.int64)
    v[at], place[at], place[zeros] = np.maximum(values[c], 1), c, places

    def smaller(step: int) -> np.ndarray:
        to, some = np.arange(len(v)) + step, at
        while len(some):
            some = some[v[to[some]] >= v[some]]
            to[some] = to[to[some]]
        return to[at]

    before = smaller(-1)
    left = place[before] + (v[before] > 0)
    right = place[smaller(1)] - 1
    return text, left - places[text], c - places[text], right - places[text]


def compact_windows(values: np.ndarray, least: int) -> np.ndarray:
    """(l, c, r) of every node of the Cartesian tree that spans ``least`` values, once for each place of a tied minimum."""
    if len(values) < least:
        return np.zeros((0, 3), dtype=np.int64)
    return np.stack(_windows_of(values, np.array([0, len(values)]), least)[1:], axis=1)


def windows(found: list[np.ndarray], least: int, hashes: int) -> Iterator[tuple[int, np.ndarray, tuple]]:
    """hash, sig, (text number, l, c, r) of the compact windows of some texts, given by their tokens."""
    places = np.concatenate([[0], np.cumsum([len(t) for t in found], dtype=np.int64)])
    if places[-1] < least:
        return
    values = np.concatenate(found)
    for j in range(hashes):
        of = mix(values ^ _SEEDS[j])
        text, left, c, right = _windows_of(of, places, least)
        yield j, of[c + places[text]], (text, left, c, right)


def once(sigs: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different signatures of each text, whose numbers do not fall: repeated lines have many windows of one signature."""
    order = np.argsort(sigs, kind="stable")
    sigs, text = sigs[order], text[order]
    new = np.ones(len(sigs), dtype=bool)
    new[1:] = (sigs[1:] != sigs[:-1]) | (text[1:] != text[:-1])
    return sigs[new], text[new]


def signatures(texts: DataFrame, least: int, hashes: int) -> DataFrame:
    """doc_id and sig of the windows of all ``texts`` (i, t), each signature once a text."""
    kind = texts.schema["i"].dataType.simpleString()

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch["t"].tolist()
            for a, b in slices(rows):
                found = [once(sigs, text) for _, sigs, (text, *_) in windows(tokens(rows[a:b]), least, hashes)]
                if found:
                    sigs, text = (np.concatenate(v) for v in zip(*found, strict=True))
                    yield pd.DataFrame({"doc_id": batch["i"].iloc[a + text].array, "sig": sigs.view(np.int64)})

    return texts.mapInPandas(made, f"doc_id {kind}, sig long")


def agreed(h: np.ndarray, l: np.ndarray, c: np.ndarray, r: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Interval join in a text: spans (low, high) of the passages that the windows of two hash functions agree on."""
    order = np.lexsort((c, r, l, h))
    h, l, c, r = h[order], l[order], c[order], r[order]
    first = np.ones(len(h), dtype=bool)  # the places of one tied minimum are neighbours
    first[1:] = (h[1:] != h[:-1]) | (l[1:] != l[:-1]) | (r[1:] != r[:-1])
    wide = np.int64(1) << np.int64(32)
    places = (np.cumsum(first) - 1) * wide + c
    h, l, r = h[first], l[first], r[first]
    if h[0] == h[-1]:
        return []
    steps = np.zeros(int(r.max()) + 2, dtype=np.int64)

    def held(which, low, high):
        at = np.searchsorted(places, which * wide + low)
        return (at < len(places)) & (places[np.minimum(at, len(places) - 1)] <= which * wide + high)

    for a in range(0, len(h), 512):  # each window with those of all later functions
        one = np.arange(a, min(a + 512, len(h)))
        others = np.arange(np.searchsorted(h, h[a], side="right"), len(h))
        meet = np.minimum(r[one, None], r[others]) - np.maximum(l[one, None], l[others]) + 1 >= least
        p, q = np.nonzero(meet & (h[one, None] < h[others]))
        m, n = one[p], others[q]
        low, high = np.maximum(l[m], l[n]), np.minimum(r[m], r[n])
        ok = held(m, low, high) & held(n, low, high)
        steps += np.bincount(low[ok], minlength=len(steps)) - np.bincount(high[ok] + 1, minlength=len(steps))
    inside = np.diff(np.concatenate([[0], (np.cumsum(steps) > 0).astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(inside == 1).tolist(), (np.flatnonzero(inside == -1) - 1).tolist(), strict=True))


def ranges_of(found: list[np.ndarray], shared: np.ndarray, least: int, hashes: int) -> list[list[tuple[int, int]]]:
    """The spans of each text that its windows with a signature in ``shared`` agree on."""
    parts = []
    shared = np.sort(shared)
    for j, sigs, where in windows(found, least, hashes):
        at = np.searchsorted(shared, sigs.view(np.int64))
        keep = shared[np.minimum(at, len(shared) - 1)] == sigs.view(np.int64)
        parts.append(np.stack([np.full(keep.sum(), j), *[w[keep] for w in where]]))
    out: list[list[tuple[int, int]]] = [[] for _ in found]
    if parts:
        h, text, left, c, right = np.concatenate(parts, axis=1)
        order = np.argsort(text, kind="stable")
        edges = np.searchsorted(text[order], np.arange(len(found) + 1))
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if a < b:
                some = order[a:b]
                out[i] = agreed(h[some], left[some], c[some], right[some], least)
    return out


def picked(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the runs that winnowing picks: the last smallest of each ``PICK`` neighbours."""
    grams = shingles(found, np.array([0, len(found)]), RUN)[0][: max(0, len(found) - RUN + 1)]
    if len(grams) < PICK:
        return grams[:0], np.zeros(0, dtype=np.int64)
    least, at = grams, np.arange(len(grams))
    for j in range(1, PICK):
        least, later = least[:-1], grams[j:]
        at = np.where(later <= least, np.arange(j, len(grams)), at[:-1])
        least = np.minimum(least, later)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]  # they never go back
    return grams[at], at


def within(spans: list, size: int) -> np.ndarray:
    """Which of ``size`` tokens lie in one of the spans (low, high)."""
    steps = np.zeros(size + 1, dtype=np.int64)
    for span in spans:
        steps[max(0, span[0])] += 1
        steps[min(size, span[1] + 1)] -= 1
    return np.cumsum(steps[:-1]) > 0


def _by_text(texts: DataFrame, others: DataFrame, make, kind: str) -> DataFrame:
    """doc_id, gram, c: what ``make(tokens of some texts, their cells of column x of others)`` gives for each text."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch["t"].tolist()
            for a, b in slices(rows):
                found = make(tokens(rows[a:b]), batch["x"].iloc[a:b].tolist())
                which = np.repeat(np.arange(a, b), [len(at) for _, at in found])
                if len(which):
                    grams, at = (np.concatenate(v) for v in zip(*found, strict=True))
                    yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[which].array, "gram": grams, "c": at})

    joined = texts.join(others, texts["i"] == others["doc_id"]).select("doc_id", "t", "x")
    return joined.mapInPandas(made, f"doc_id {kind}, gram long, c int")


def runs_of(found: np.ndarray, spans: list) -> tuple[np.ndarray, np.ndarray]:
    if not spans:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
    grams, at = picked(found)
    inside = within(spans, len(found))
    keep = inside[at] & inside[at + RUN - 1] if len(at) else np.zeros(0, dtype=bool)
    return grams[keep].view(np.int64), at[keep].astype(np.int32)


def passages_of(found: np.ndarray, opened: list, least: int) -> tuple[np.ndarray, np.ndarray]:
    """All passages of ``least`` tokens around a text's open runs."""
    inside = within([(c - least, c + RUN + least) for c in opened], len(found))
    at = np.flatnonzero(inside[: len(found) - least + 1] & inside[least - 1 :]) if len(found) >= least else np.zeros(0, int)
    return stretches(found, at, least).view(np.int64), at.astype(np.int32)


def led(runs: DataFrame) -> DataFrame:
    """doc_id, gram, c of the runs with a smaller document, their leader; and its first and last place a, z of the run."""
    of = Window.partitionBy("gram")
    leading = F.when(F.col("doc_id") == F.col("leader"), F.col("c"))
    return (
        runs.withColumn("leader", F.min("doc_id").over(of))
        .withColumn("a", F.min(leading).over(of))
        .withColumn("z", F.max(leading).over(of))
        .where("doc_id <> leader")
    )


def candidates(runs: DataFrame, margin: int) -> DataFrame:
    """doc_id, leader, anchors, leader_low, leader_high: a row per pair of ``led`` runs, with what it needs of the leader's text."""
    block = 256  # few different stretches of one leader
    return runs.groupBy("doc_id", "leader").agg(
        F.collect_set("c").alias("anchors"),
        (F.floor(F.greatest(F.lit(0), F.min("a") - margin) / block) * block).cast("int").alias("leader_low"),
        (F.ceil((F.max("z") + RUN + margin) / block) * block).cast("int").alias("leader_high"),
    )


def grown(
    x: np.ndarray, d: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray, similarity: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The longest stretch around each match ``at`` whose either side has ``similarity`` of equal tokens, and its equal tokens.

    Matches are places ``x`` on diagonals ``d`` (numbered from 0, in order of d, x), which reach from ``low`` to ``high``.
    A sum gains q - p at a match and loses p at any other place, for ``similarity`` p / q: just before a match it is
    lowest, just behind one it is highest. Each diagonal's sums are set below those of the one before.
    """
    share = Fraction(similarity).limit_denominator(1 << 20)
    p, q = max(1, share.numerator), share.denominator
    first = np.searchsorted(d, np.arange(len(low)))
    before = q * (np.arange(len(x)) - first[d]) - p * (x - low[d])
    before -= d * (2 * (p + q) * (int((high - low).max()) + 2))
    behind = before + (q - p)
    lowest = -np.minimum.accumulate(before)
    highest = -np.maximum.accumulate(behind[::-1])[::-1]
    of = d[at]
    opens = np.searchsorted(lowest, -behind[at], side="left")
    ends = np.searchsorted(highest, -before[at], side="right") - 1
    starts = np.maximum(low[of], x[opens] - (behind[at] - before[opens]) // p)
    # Between its first and last match a stretch holds all matches of the diagonal.
    return starts, np.minimum(high[of], x[ends] + 1 + (behind[ends] - before[at]) // p), ends - opens + 1


def matches(own: np.ndarray, order: np.ndarray, ranked: np.ndarray, at: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Equal places (of ``own``, only those in ``at``; of the text with these ranked tokens), about ``most`` at a time."""
    a, b = np.searchsorted(ranked, own[at]), np.searchsorted(ranked, own[at], side="right")
    upto = np.cumsum(b - a)
    p = 0
    while p < len(at):
        q = max(p + 1, int(np.searchsorted(upto, (upto[p - 1] if p else 0) + most, side="right")))
        n = (b - a)[p:q]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(at[p:q], n), order[np.repeat(a[p:q], n) + offset]
        p = q


def aligned(
    own: np.ndarray, order: np.ndarray, ranked: np.ndarray, low: int, high: int, shifts: tuple[int, int], least: int, similarity: float
) -> list[tuple[int, int, float]]:
    """Stretches of ``own[low:high]`` whose alignment over the diagonals ``shifts`` (first, last) has the Jaccard similarity.

    ``order`` and ``ranked``: the other text's tokens by value.
    """
    found = []
    for x, place in matches(own, order, ranked, np.arange(low, high)):
        near = (x - place >= shifts[0]) & (x - place <= shifts[1])
        found.append((x[near], x[near] - place[near]))
    x, d = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
    # Each place of own is equal once at most, and the lengths are least or more.
    if len(np.unique(x)) * (1 + similarity) < 2 * least * similarity - 1e-6:
        return []
    by = np.lexsort((x, d))
    x, d = x[by], d[by]
    opens = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (x[1:] != x[:-1] + 1)]))
    sizes = np.diff(np.append(opens, len(x)))
    by = opens[np.argsort(-sizes, kind="stable")]
    path: list[tuple[int, int, int]] = []  # in order in both texts; longer runs first win their place
    for x, n, d in zip(x[by].tolist(), -np.sort(-sizes), d[by].tolist(), strict=True):
        y = x + int(n)
        k = bisect.bisect_left(path, (x, y, d))
        if k and not (x >= path[k - 1][1] and x - d >= path[k - 1][1] - path[k - 1][2]):
            continue
        if k < len(path) and not (y <= path[k][0] and y - d <= path[k][0] - path[k][2]):
            continue
        path.insert(k, (x, y, d))
    x, y, d = (np.array(v, dtype=np.int64) for v in zip(*path, strict=True))
    both = np.concatenate([[0], np.cumsum(y - x)])
    out: list[tuple[int, int, float]] = []
    i = 0
    while i < len(x):
        m = both[i + 1 :] - both[i]
        wide = np.maximum(y[i:] - x[i], least)
        tall = np.maximum((y[i:] - d[i:]) - (x[i] - d[i]), least)
        alike = m / (wide + tall - m)
        good = np.flatnonzero(alike >= similarity - 1e-9)
        if len(good):
            k = int(good[-1])
            a, b = int(x[i]), int(y[i + k])
            # Other tokens at the ends fill the shortest passage.
            left = min(max(0, least - (b - a)), len(own) - b)
            b += left
            a = max(0, min(a, b - least))
            if b - a >= least and len(order) >= least:
                out.append((a, b, float(alike[k])))
            i += k + 1
        else:
            i += 1
    return out


def verify_pair(own: np.ndarray, theirs: np.ndarray, anchors: list[int], least: int, similarity: float) -> list[tuple[int, int, float]]:
    """Spans (start, end, similarity) of ``own`` that repeat a stretch of ``theirs``; anchors are runs of both."""
    order = np.argsort(theirs, kind="stable")
    ranked = theirs[order]
    at = np.unique(np.array(anchors, dtype=np.int64))
    # Equal tokens on each diagonal; too few of them make no passage.
    counts = np.zeros(len(own) + len(theirs), dtype=np.int64)
    held, some = [], 0
    for x, place in matches(own, order, ranked, np.arange(len(own))):
        some += len(x)
        counts += np.bincount(x - place + len(theirs), minlength=len(counts))
        if some <= MATCHES:
            held.append((x, x - place + len(theirs)))
    likely = np.flatnonzero(counts >= least * similarity - 1)
    anchored = np.zeros(len(own) + 1, dtype=bool)
    anchored[at] = True
    out: list[tuple[int, int, float]] = []
    whole = (0, 0)  # the widest equal stretch: spans inside it say nothing new
    # The fullest diagonal, then the others in groups of bounded size.
    ranks = likely[np.argsort(-counts[likely], kind="stable")]
    sizes = np.cumsum(counts[ranks[1:]]) // MATCHES
    groups = [ranks[:1], *np.split(ranks[1:], np.flatnonzero(np.diff(sizes)) + 1)]
    for group in groups:
        shift = group - len(theirs)
        low, high = np.maximum(0, shift), np.minimum(len(own), shift + len(theirs))
        new = (low < whole[0]) | (high > whole[1])
        group, shift, low, high = group[new], shift[new], low[new], high[new]
        if not len(group):
            continue
        if some <= MATCHES and len(group) > 1:
            x, d = (np.concatenate(v) for v in zip(*held, strict=True))
            number = np.full(len(counts), -1)
            number[group] = np.arange(len(group))
            d = number[d]
            x, d = x[d >= 0], d[d >= 0]
            by = np.argsort(d.astype(np.uint16) if len(group) < 1 << 16 else d, kind="stable")
            x, d = x[by], d[by]
        else:
            found = [a + np.flatnonzero(own[a:b] == theirs[a - s : b - s]) for a, b, s in zip(low, high, shift, strict=True)]
            x, d = np.concatenate(found), np.repeat(np.arange(len(group)), counts[group])
        places = np.flatnonzero(anchored[x])
        starts, ends, equal = grown(x, d, low, high, places, similarity)
        wide = ends - starts >= least
        starts, ends, equal, places = starts[wide], ends[wide], equal[wide], places[wide]
        line = d[places] * (len(own) + 1)
        after = np.searchsorted(line + x[places], line + ends)  # the next anchor behind the stretch
        taken, k = [], 0
        while k < len(after):
            taken.append(k)
            k = after.item(k)
        starts, ends, alike = starts[taken], ends[taken], (equal / (ends - starts))[taken]
        out += zip(starts.tolist(), ends.tolist(), alike.tolist(), strict=True)
        whole = max([whole, *zip(starts[alike == 1].tolist(), ends[alike == 1].tolist(), strict=True)], key=lambda s: s[1] - s[0])
    covered = within([(a, b - 1) for a, b, _ in out], len(own))
    # Words put in or left out move the diagonal: what no single diagonal covers is aligned over neighbouring ones.
    left = list(matches(own, order, ranked, at[~covered[at]]))
    if not left:
        return out
    places, theirs_at = (np.concatenate(v) for v in zip(*left, strict=True))
    by = np.argsort(places - theirs_at, kind="stable")
    places, shifts = places[by], (places - theirs_at)[by]
    cuts = [0, *(np.flatnonzero(np.diff(shifts) > BAND) + 1).tolist(), len(shifts)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        if i == j:
            continue
        some = np.unique(places[i:j])
        edges = [0, *(np.flatnonzero(np.diff(some) > 4 * least) + 1).tolist(), len(some)]
        for p, q in zip(edges[:-1], edges[1:], strict=True):
            low, high = max(0, int(some[p]) - 2 * least), min(len(own), int(some[q - 1]) + 2 * least)
            near = (int(shifts[i]) - BAND, int(shifts[j - 1]) + BAND)
            out += aligned(own, order, ranked, low, high, near, least, similarity)
    return out


def widest(spans: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """The spans that lie in no other one, each with the highest similarity of all it overlaps with, directly or by others."""
    out: list[tuple[int, int, float]] = []
    island: list[tuple[int, int]] = []
    best = reach = -1.0

    for a, b, alike in [*sorted(spans, key=lambda s: (s[0], -s[1])), (1 << 62, 1 << 62, 0.0)]:
        if a - (WORDS - 1) > reach:  # spans of tokens: their words overlap or touch a little longer
            out += [(x, y, best) for x, y in island]
            island, best, reach = [], -1.0, -1.0
        if b > reach:
            island.append((a, b))
            reach = b
        best = max(best, alike)
    return out


def repeated_passages(
    docs: DataFrame,
    least_words: int = LEAST_WORDS,
    hashes: int = HASHES,
    similarity: float = SIMILARITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, keep_id, start_word, end_word, similarity: passages of a text that another one keeps."""
    least = least_words - WORDS + 1
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    of = Window.partitionBy("sig")
    repeated = (
        signatures(texts, least, hashes)
        .withColumn("a", F.min("doc_id").over(of))
        .withColumn("z", F.max("doc_id").over(of))
        .where("a <> z")
    )
    shared = repeated.groupBy("doc_id").agg(F.collect_set("sig").alias("x"))

    def runs_in(found: list[np.ndarray], sigs: list) -> list[tuple[np.ndarray, np.ndarray]]:
        spans = ranges_of(found, np.concatenate(sigs), least, hashes)
        return [runs_of(t, s) for t, s in zip(found, spans, strict=True)]

    runs = stored(_by_text(texts, shared, runs_in, kind), "runs")
    found = stored(candidates(led(runs), 2 * least), "candidates")
    wanted = (
        found.groupBy("leader")
        .agg(F.collect_set(F.struct("leader_low", "leader_high")).alias("spans"))  # multiples of a block
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["t"].tolist()
            for a, b in slices(texts):
                rows = []
                for i, found in enumerate(tokens(texts[a:b]), a):
                    for span in batch["spans"].iloc[i]:
                        low, high = span["leader_low"], span["leader_high"]
                        rows.append((batch["leader"].iloc[i], low, high, found[low:high].tobytes()))
                yield pd.DataFrame(rows, columns=["leader", "leader_low", "leader_high", "passage"])

    passages = (
        texts.join(wanted, texts["i"] == wanted["leader"])
        .select("leader", "t", "spans")
        .mapInPandas(cut, f"leader {kind}, leader_low int, leader_high int, passage binary")
        .dropDuplicates(["leader", "leader_low", "leader_high"])
    )
    offered = found.join(passages, ["leader", "leader_low", "leader_high"]).select(
        "doc_id", "leader", "anchors", "passage"
    )

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, passages, anchors = (batch[x].tolist() for x in ("t", "passage", "anchors"))
            parts = []  # number of the row, start, end, similarity, run
            for a, b in slices(texts):
                several = list(dict.fromkeys(texts[a:b]))  # a text comes once for each of its leaders
                of = dict(zip(several, tokens(several), strict=True))
                for i in range(a, b):
                    own, theirs, at = of[texts[i]], np.frombuffer(passages[i], np.uint64), np.asarray(anchors[i])
                    at = at[at < len(own)]  # another row of the id may be shorter
                    made = np.array(widest(verify_pair(own, theirs, at, least, similarity)), dtype=np.float64).reshape(-1, 3)
                    low, high = made[:, 0].astype(np.int64), made[:, 1].astype(np.int64) + WORDS - 1
                    opened = at[~inside_one(low, high, at)]
                    grams = shingles(own, np.array([0, len(own)]), RUN)[0][opened].view(np.int64) if len(opened) else opened
                    parts.append((np.full(len(low), i), low, high, made[:, 2], np.zeros(len(low), dtype=np.int64)))
                    parts.append((np.full(len(opened), i), opened, np.full(len(opened), -1), np.zeros(len(opened)), grams))
            if parts:
                which, *cells = (np.concatenate(v) for v in zip(*parts, strict=True))
                out = batch[["doc_id", "leader"]].iloc[which].reset_index(drop=True).set_axis(["doc_id", "keep_id"], axis=1)
                yield out.assign(**dict(zip(("start_word", "end_word", "similarity", "gram"), cells, strict=True)))
    verdicts = stored(
        texts.join(offered, texts["i"] == offered["doc_id"])
        .select("doc_id", "t", "leader", "anchors", "passage")
        .mapInPandas(
            verified, f"doc_id {kind}, keep_id {kind}, start_word long, end_word long, similarity double, gram long"
        ),
        "spans",
    )
    spans = verdicts.where("end_word >= 0").drop("gram")
    opened = verdicts.where("end_word < 0").select("doc_id", F.col("start_word").alias("c"), "gram")
    return merged(spans.unionByName(equal_passages(texts, runs, opened, spans, least, kind)))


def inside_one(starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which runs, by their first words, lie in one of the spans of words; these are in order."""
    if not len(starts):
        return np.zeros(len(at), dtype=bool)
    k = np.searchsorted(starts, at, side="right") - 1
    return (k >= 0) & (np.maximum.accumulate(ends)[np.maximum(k, 0)] >= at + RUN + WORDS - 1)


def equal_passages(texts: DataFrame, runs: DataFrame, opened: DataFrame, spans: DataFrame, least: int, kind: str) -> DataFrame:
    """Spans of equal passages around the runs that no accepted stretch of their text covers.

    ``opened``: doc_id, c, gram of the runs that no stretch shared with their leader covers.
    """
    some = spans.join(opened.select("doc_id").distinct(), "doc_id", "left_semi")
    settled = some.groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "end_word")).alias("done"))
    covered = F.exists("done", lambda s: (s["start_word"] <= F.col("c")) & (F.col("c") + RUN + WORDS - 1 <= s["end_word"]))
    left = (
        opened.join(settled, "doc_id", "left")
        .where(F.coalesce(~covered, F.lit(True)))
        .select("gram")
        .distinct()
    )
    around = runs.join(left, "gram", "left_semi").groupBy("doc_id").agg(F.collect_set("c").alias("x"))
    made = lambda found, places: [passages_of(t, c, least) for t, c in zip(found, places, strict=True)]
    grams = stored(_by_text(texts, around, made, kind), "equal")
    of = Window.partitionBy("gram")
    return (
        grams.withColumn("keep_id", F.min("doc_id").over(of))
        .where("doc_id <> keep_id")
        .select(
            "doc_id",
            "keep_id",
            F.col("c").cast("long").alias("start_word"),
            (F.col("c") + least + WORDS - 1).cast("long").alias("end_word"),
            F.lit(1.0).alias("similarity"),
        )
    )


def merged(spans: DataFrame) -> DataFrame:
    """Overlapping spans of one pair of documents as one."""
    ordered = Window.partitionBy("doc_id", "keep_id").orderBy("start_word", "end_word")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce((F.col("start_word") > F.max("end_word").over(before)).cast("int"), F.lit(1))
    return (
        spans.withColumn("opens", opens)
        .withColumn("island", F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "keep_id", "island")
        .agg(
            F.min("start_word").alias("start_word"),
            F.max("end_word").alias("end_word"),
            F.max("similarity").alias("similarity"),
        )
        .drop("island")
    )
