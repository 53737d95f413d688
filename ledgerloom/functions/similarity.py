"""Similarity of strings: share of the longest common subsequence, 0 to 100.

``ratio`` is 200 * LCS / (len a + len b).  Against a fixed word of up to
WORD_BITS letters it is a JVM expression with the word's positions as bits of
one number, whatever the length of the other string.  Pairs of columns, longer
words and windows are scored in vectorised batches: the same recurrence over
as many numbers as the longer word needs, a whole batch of strings at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Positions held in one number; a bit is left for the carry, one for the sign.
WORD_BITS = 62
FULL = np.uint64((1 << WORD_BITS) - 1)
#: Characters of a batch of strings padded to one length.
CELLS = 2_000_000


def alike_lengths(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Positions in groups of like lengths, so that padding a group to its longest stays within CELLS."""
    order = np.argsort(lengths, kind="stable")
    lo = 0
    while lo < len(order):
        hi = len(order)
        while hi - lo > 1 and (hi - lo) * int(lengths[order[hi - 1]]) > CELLS:
            hi = lo + (hi - lo) // 2
        yield order[lo:hi]
        lo = hi


def letters(strings: list[str]) -> np.ndarray:
    """Code points, a row per string, zero beyond its end."""
    width = max(1, max(map(len, strings), default=1))
    return np.array(strings, f"<U{width}").view("<u4").reshape(len(strings), width)


def _advance(state: list[np.ndarray], hits: list[np.ndarray]) -> None:
    """One letter further: the bits of a common subsequence fall from one to zero."""
    carry = np.uint64(0)
    for w, hit in enumerate(hits):
        u = state[w] & hit
        t = state[w] + u + carry
        carry = t >> np.uint64(WORD_BITS)
        state[w] = (t & FULL) | (state[w] - u)


def common_to(word: str, strings: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of a word and each string."""
    known = sorted(set(word))
    words = -(-len(word) // WORD_BITS)
    # Row 0 is for letters that the word lacks.
    table = np.zeros((words, len(known) + 1), np.uint64)
    for k, c in enumerate(word):
        table[k // WORD_BITS, known.index(c) + 1] |= np.uint64(1 << k % WORD_BITS)
    codes = np.array([ord(c) for c in known], np.uint32)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    out = np.zeros(len(strings), np.int64)
    for at in alike_lengths(lengths) if word else ():
        theirs = letters([strings[k] for k in at.tolist()])
        place = np.searchsorted(codes, theirs).clip(max=len(codes) - 1)
        place = np.where((codes[place] == theirs) & (np.arange(theirs.shape[1]) < lengths[at, None]), place + 1, 0)
        state = [np.full(len(at), FULL) for _ in range(words)]
        for j in range(theirs.shape[1]):
            _advance(state, [table[w][place[:, j]] for w in range(words)])
        out[at] = sum(np.bitwise_count(~s & FULL).astype(np.int64) for s in state)
    return out


def common(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair."""
    la, lb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    out = np.zeros(len(a), np.int64)
    for at in alike_lengths(np.maximum(la, lb)):
        ours, theirs = letters([a[k] for k in at.tolist()]), letters([b[k] for k in at.tolist()])
        # Ends differ from each other and from every letter.
        ours = np.where(np.arange(ours.shape[1]) < la[at, None], ours, 0xFFFFFFFE)
        theirs = np.where(np.arange(theirs.shape[1]) < lb[at, None], theirs, 0xFFFFFFFF)
        spans = [range(w, min(w + WORD_BITS, ours.shape[1])) for w in range(0, ours.shape[1], WORD_BITS)]
        state = [np.full(len(at), FULL) for _ in spans]
        for j in range(theirs.shape[1]):
            hits = []
            for span in spans:
                hit = np.zeros(len(at), np.uint64)
                for i in span:
                    hit |= (ours[:, i] == theirs[:, j]).astype(np.uint64) << np.uint64(i - span.start)
                hits.append(hit)
            _advance(state, hits)
        out[at] = sum(np.bitwise_count(~s & FULL).astype(np.int64) for s in state)
    return out


def ratios_to(word: str, strings: list[str]) -> np.ndarray:
    """Similarity of a word to each string; empty strings only equal each other."""
    total = len(word) + np.fromiter(map(len, strings), np.int64, len(strings))
    return np.where(total == 0, 100.0, 200.0 * common_to(word, strings) / np.maximum(total, 1))


def windows(text: str, size: int) -> list[str]:
    """All stretches of ``size`` letters, those cut off by either end included."""
    return [text[max(0, k - size) : k] for k in range(1, len(text) + size)]


def partial_ratios_to(word: str, strings: list[str]) -> np.ndarray:
    """Best similarity of the shorter string to any window of the longer, for each string; of equally long ones both ways."""
    out = np.zeros(len(strings))
    over = [k for k, s in enumerate(strings) if s and len(s) >= len(word)]
    # Windows of the strings against the word, a bounded number at a time.
    lo = 0
    while lo < len(over):
        hi, parts = lo, []
        while hi < len(over) and len(parts) * max(1, len(word)) < CELLS:
            parts.append(windows(strings[over[hi]], len(word)))
            hi += 1
        score = ratios_to(word, [w for p in parts for w in p])
        starts = np.cumsum([0, *map(len, parts)])[:-1]
        out[over[lo:hi]] = np.maximum.reduceat(score, starts)
        lo = hi
    for k, s in enumerate(strings):
        if s and len(s) <= len(word):
            out[k] = max(out[k], ratios_to(s, windows(word, len(s))).max())
    return out


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Similarity of each pair; empty strings only equal each other."""
    total = np.fromiter((len(x) + len(y) for x, y in zip(a, b, strict=True)), np.int64, len(a))
    return np.where(total == 0, 100.0, 200.0 * common(a, b) / np.maximum(total, 1))


# Fixed values of the weighted ratio: what token and partial scores count, and the lengths from which parts are compared, and count less.
TOKEN_SHARE, PARTIAL_SHARE, FAR_SHARE = 0.95, 0.9, 0.6
PARTS_FROM, FAR_FROM = 1.5, 8.0


def _compared(a: str, b: str) -> Iterator[tuple[str, str, float]]:
    """What the weighted ratio compares of two strings: pairs with the share that each counts; equal pairs count in full."""
    yield a, b, 1.0
    ta, tb = a.split(), b.split()
    sa, sb = set(ta), set(tb)
    both, only_a, only_b = (" ".join(sorted(x)) for x in (sa & sb, sa - sb, sb - sa))
    sorted_a, sorted_b = " ".join(sorted(ta)), " ".join(sorted(tb))
    long, short = max(len(a), len(b)), min(len(a), len(b))
    if long < PARTS_FROM * short:
        yield sorted_a, sorted_b, TOKEN_SHARE
        whole_a, whole_b = (f"{both} {x}".strip() for x in (only_a, only_b))
        yield whole_a, whole_b, TOKEN_SHARE
        if both:
            yield both, whole_a, TOKEN_SHARE
            yield both, whole_b, TOKEN_SHARE
        return
    share = PARTIAL_SHARE if long < FAR_FROM * short else FAR_SHARE
    pairs = [(a, b, share)] + ([("", "", share * TOKEN_SHARE)] if both else [(x, y, share * TOKEN_SHARE) for x, y in {(sorted_a, sorted_b), (only_a, only_b)}])
    for x, y, part in pairs:
        few, many = sorted((x, y), key=len)
        yield from ((few, w, part) for w in (windows(many, len(few)) if few else [many]))
        if len(few) == len(many):
            yield from ((many, w, part) for w in windows(few, len(many)))


def weighted_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """The best of whole, token and partial similarity of each pair, each by its share; 0 where either is empty."""
    out = np.zeros(len(a))
    at = [k for k in range(len(a)) if a[k] and b[k]]
    lo = 0
    while lo < len(at):
        hi, items, starts = lo, [], []
        while hi < len(at) and len(items) < CELLS // 64:
            starts.append(len(items))
            items += _compared(a[at[hi]], b[at[hi]])
            hi += 1
        x, y, share = zip(*items, strict=True)
        out[at[lo:hi]] = np.maximum.reduceat(ratios(list(x), list(y)) * np.array(share), starts)
        lo = hi
    return out


@F.pandas_udf(T.DoubleType())
def weighted_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """weighted_ratios of two columns, a null counting as empty; equal pairs are compared once."""
    pairs = pd.DataFrame({"a": a.fillna("").to_numpy(), "b": b.fillna("").to_numpy()})
    codes = pairs.groupby(["a", "b"], sort=False).ngroup().to_numpy()
    first = pairs.drop_duplicates()
    return pd.Series(weighted_ratios(first["a"].tolist(), first["b"].tolist())[codes] if len(pairs) else [], dtype="float64")


def ratio_to(word: str, c: Column) -> Column:
    """Similarity of a column to a fixed word, 0 to 100."""
    if not word:
        return F.when(c == "", 100.0).otherwise(0.0)
    if len(word) > WORD_BITS:

        @F.pandas_udf(T.DoubleType())
        def scored(strings: pd.Series) -> pd.Series:
            return pd.Series(ratios_to(word, strings.fillna("").tolist())).where(strings.notna().to_numpy())

        return scored(c)
    places: dict[str, int] = {}
    for k, ch in enumerate(word):
        places[ch] = places.get(ch, 0) | 1 << k
    table = F.create_map(*(F.lit(x) for ch, mask in places.items() for x in (ch, mask)))
    full = F.lit((1 << len(word)) - 1).cast("long")
    chars = F.filter(F.split(c, ""), lambda x: x != "")

    def step(s: Column, ch: Column) -> Column:
        hit = s.bitwiseAND(F.coalesce(F.try_element_at(table, ch), F.lit(0)).cast("long"))
        return (s + hit).bitwiseOR(s - hit).bitwiseAND(full)

    lcs = len(word) - F.bit_count(F.aggregate(chars, full, step))
    return F.when(c == "", 0.0).otherwise(200.0 * lcs / (len(word) + F.length(c)))


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two columns, 0 to 100; empty strings only equal each other, null gives null."""
    both = (a.notna() & b.notna()).to_numpy()
    x, y = a.fillna("").tolist(), b.fillna("").tolist()
    return pd.Series(ratios(x, y)).where(both)


def partial_ratio_to(word: str, c: Column) -> Column:
    """partial_ratios_to of a column."""

    @F.pandas_udf(T.DoubleType())
    def scored(strings: pd.Series) -> pd.Series:
        return pd.Series(partial_ratios_to(word, strings.fillna("").tolist())).where(strings.notna().to_numpy())

    return scored(c)


def pieces_needed(word: str, least: float) -> set[str]:
    """Pieces of a word of which whatever is so similar to it has one; an empty one among them, if no piece is needed.

    The similarity fixes how many letters may be inserted or deleted, d at
    most.  Of d + 1 pieces of the word one then comes through unchanged, so a
    string without any of them need not be compared.
    """
    m = len(word)
    d = int((1 - least / 100) * (m + m * (200 - least) / least)) if least > 0 else m
    cuts = [m * k // (d + 1) for k in range(d + 2)]
    return {word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)}


def could_reach(word: str, least: float, c: Column) -> Column:
    """Whether a string may reach a similarity to a word at all: whether it has one of the pieces needed."""
    pieces = pieces_needed(word, least)
    if "" in pieces:
        return F.lit(True)
    hit = F.lit(False)
    for p in sorted(pieces):
        hit = hit | c.contains(p)
    return hit


def ratio_sql(a: str, b: str) -> str:
    """The same ratio as a DuckDB expression, for strings of up to 120 letters."""
    mask = f"coalesce(list_sum(list_transform(string_split({a}, ''), lambda x, i: CASE WHEN x = ch THEN (1::HUGEINT << (i - 1)::INT) ELSE 0 END)), 0)::HUGEINT"
    full = f"((1::HUGEINT << length({a})::INT) - 1)"
    fold = f"list_reduce(list_transform(string_split({b}, ''), lambda ch: {mask}), lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full}, {full})"
    lcs = f"(length({a}) - bit_count({fold}))"
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 100.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE (200.0::DOUBLE * {lcs} / (length({a}) + length({b})))::DOUBLE END"
