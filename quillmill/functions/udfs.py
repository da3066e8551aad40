"""Functions that Spark's built-ins can't express, as Arrow-batched UDFs.

Use them after joins and filters: Spark evaluates Python functions in a node
of their own, so a ``CASE`` around one does not save its cost.
"""

from __future__ import annotations

import difflib
import os.path
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

#: Types as objects: names would need a session when this module is imported.
SEGMENTS = ArrayType(StructType([StructField("ord", IntegerType()), StructField("kind", StringType()), StructField("val", StringType())]))

#: Fixed value: similarity from which on difflib pairs two words.
CLOSE = 0.75


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, bit-parallel over one integer.

    A common beginning and end belong to it whole; what is left between them
    is short for the nearly equal texts that pass the length bound.
    """
    if len(a) > len(b):
        a, b = b, a
    head = len(os.path.commonprefix((a, b)))
    a, b = a[head:], b[head:]
    tail = len(os.path.commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a:
        return head + tail
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return head + tail + len(a) - v.bit_count()


def ratio(a: str | None, b: str | None) -> int:
    """Indel similarity, 0 to 100, rounded; 0 with a null, 100 for two empty strings."""
    if a is None or b is None:
        return 0
    total = len(a) + len(b)
    return round(200 * lcs_length(a, b) / total) if total else 100


def _letters(words: list[str]) -> np.ndarray:
    """How often each of 64 classes of letters stands in each word."""
    out = np.zeros((len(words), 64), dtype=np.int16)
    for k, word in enumerate(words):
        for c in word:
            out[k, ord(c) & 63] += 1
    return out


def close_pairs(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, similarity) of all different words a[i], b[j] that are CLOSE, by j, then i.

    Each two distinct words are compared once, and only those whose lengths and
    letters leave room for it: common letters bound difflib's similarity from above.
    """
    at_a, at_b = {}, {}
    for words, at in ((a, at_a), (b, at_b)):
        for k, word in enumerate(words):
            at.setdefault(word, []).append(k)
    ua = list(at_a)
    la = np.array([len(w) for w in ua])
    ca: np.ndarray | None = None
    cruncher = difflib.SequenceMatcher(None)
    found = []
    for word in at_b:
        rows = np.flatnonzero(2 * np.minimum(la, len(word)) >= CLOSE * (la + len(word)))
        if not len(rows):
            continue
        ca = _letters(ua) if ca is None else ca
        rows = rows[2 * np.minimum(ca[rows], _letters([word])).sum(1) >= CLOSE * (la[rows] + len(word))]
        if len(rows):
            cruncher.set_seq2(word)
            for x in rows:
                if ua[x] != word:
                    cruncher.set_seq1(ua[x])
                    if (score := cruncher.ratio()) >= CLOSE:
                        found += [(j, i, score) for j in at_b[word] for i in at_a[ua[x]]]
    found.sort()
    j, i, score = (np.array(c) for c in zip(*found)) if found else (np.zeros(0, dtype=int),) * 3
    return i, j, score


def paired_words(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """A replaced block as difflib shows it: the closest pair is struck and inserted together, likewise what stands before and after it.

    Without a close pair the first two equal words are kept; without these,
    the shorter side comes first, whole.
    """
    i, j, score = close_pairs(a, b)
    out: list[tuple[str, str]] = []
    # blocks that are still open (the last is next), or finished words
    todo: list = [(0, len(a), 0, len(b), np.arange(len(i)))]
    while todo:
        item = todo.pop()
        if len(item) == 2:
            out.append(item)
            continue
        alo, ahi, blo, bhi, close = item
        struck, put = [("strike", w) for w in a[alo:ahi]], [("insert", w) for w in b[blo:bhi]]
        if not struck or not put:
            out += struck + put
            continue
        close = close[(i[close] >= alo) & (i[close] < ahi) & (j[close] >= blo) & (j[close] < bhi)]
        if len(close):
            best = close[np.argmax(score[close])]
            x, y = int(i[best]), int(j[best])
            middle = [("insert", b[y]), ("strike", a[x])]
        else:
            # equal words at the beginning are kept one after the other
            equal = next((k for k, (x, y) in enumerate(zip(a[alo:ahi], b[blo:bhi])) if x != y), min(ahi - alo, bhi - blo))
            if equal:
                out += [("text", w) for w in a[alo : alo + equal]]
                todo.append((alo + equal, ahi, blo + equal, bhi, close))
                continue
            have = set(a[alo:ahi])
            same = next((k for k in range(blo, bhi) if b[k] in have), None)
            if same is None:
                out += put + struck if len(put) < len(struck) else struck + put
                continue
            x, y = a.index(b[same], alo, ahi), same
            middle = [("text", a[x])]
        todo += [(x + 1, ahi, y + 1, bhi, close), *middle, (alo, x, blo, y, close)]
    return out


#: Fixed value: words from which on difflib leaves frequent ones out of its search.
MANY_WORDS = 200
#: Words of a run that is looked for elsewhere, at most.
LONG_RUN = 8


def one_word(a: list[str], b: list[str]) -> int | None:
    """Where the only word stands that differs, if difflib surely shows the two texts so; else None.

    Let a be P x S and b be P y S. A common block that holds b's y begins from
    a y of a; if all such blocks are shorter than P and S (those that are not
    empty), the blocks that difflib takes lie in the P or the S of b. It takes
    the longest, of equally long ones the first in a. If P is not shorter, that
    is P itself; then S must not begin at x in a, as it would if it were x x x.
    Otherwise S must have no earlier place in a; P is then found before it.
    From MANY_WORDS on `one_of_many` judges.
    """
    n = len(a)
    if n != len(b) or not n:
        return None
    at = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), None)
    if at is None or a[at + 1 :] != b[at + 1 :]:
        return None
    if n >= MANY_WORDS:
        return one_of_many(a, b, at)
    rest = n - at - 1
    if b[at] in a:
        room = min(at or rest, rest or at)
        for q in [k for k, x in enumerate(a) if x == b[at]]:
            low = high = 0
            while low < min(q, at) and a[q - low - 1] == b[at - low - 1]:
                low += 1
            while high < n - 1 - max(q, at) and a[q + high + 1] == b[at + high + 1]:
                high += 1
            if low + high + 1 >= room:
                return None
    if rest and at >= rest:
        return None if a[at:-1] == a[at + 1 :] else at
    tail = a[at + 1 :]
    return None if any(a[i] == tail[0] and a[i : i + rest] == tail for i in range(at + 1) if rest) else at


def one_of_many(a: list[str], b: list[str], at: int) -> int | None:
    """The same for texts in which difflib leaves words out that are more than a hundredth of b.

    It takes the longest run of other words, and then all that is equal beside
    it: the P or the S that has the longest run, whole, if no such run stands at
    another place; then the other one, if its longest run does so beside x and y.
    """
    n, counts, most = len(b), Counter(b), len(b) // 100 + 1
    runs, run = [], 0  # how many other words end at each place
    for word in b:
        run = run + 1 if counts[word] <= most else 0
        runs.append(run)

    def longest(low: int, high: int) -> int:
        return min(LONG_RUN, max((min(r, k + 1) for k, r in enumerate(runs[low:high])), default=0))

    def alone(low: int, high: int, k: int) -> bool:
        """Whether runs of k words are in one place only, between the bounds."""
        ends = [j + 1 for j in range(low + k - 1, high) if runs[j] >= k]
        seen = {tuple(b[j - k : j]) for j in ends}
        return k > 0 and len(seen) == len(ends) and not any(tuple(a[i : i + k]) in seen for i in range(max(low, at - k + 1), min(at, high - k) + 1))

    before, after = longest(0, at), longest(at + 1, n)
    first, (low, high, rest, size) = (before, (at, n, after, n - at - 1)) if before >= after else (after, (0, at + 1, before, at))
    return at if alone(0, n, first) and (not size or alone(low, high, rest)) else None


#: Two words as a replaced block, CACHED_PAIRS of them at most.
_pairs: dict[tuple[str, str], list[tuple[str, str]]] = {}
CACHED_PAIRS = 4096


def _paired(x: str, y: str) -> list[tuple[str, str]]:
    found = _pairs.get((x, y))
    if found is None:
        found = paired_words([x], [y])
        if len(_pairs) < CACHED_PAIRS:
            _pairs[x, y] = found
    return found


def ndiff_words(old: str | None, new: str | None) -> list[tuple[int, str, str]]:
    """Word diff: (position, kind, word and blank), kinds text, strike, insert.

    The result is that of difflib.ndiff over words without its hint lines,
    for blocks of any size; similarities are worked out once per two words.
    """
    a, b = (old or "").split(), (new or "").split()
    at = one_word(a, b)
    if at is not None:
        changed = _paired(a[at], b[at])
        out = [("text", w) for w in a[:at]] + changed + [("text", w) for w in a[at + 1 :]]
        return [(k, kind, w + " ") for k, (kind, w) in enumerate(out)]
    out: list[tuple[str, str]] = []
    for tag, alo, ahi, blo, bhi in difflib.SequenceMatcher(None, a, b).get_opcodes():
        if tag == "equal":
            out += [("text", w) for w in a[alo:ahi]]
        elif tag == "replace":
            out += paired_words(a[alo:ahi], b[blo:bhi])
        else:
            out += [("strike", w) for w in a[alo:ahi]] + [("insert", w) for w in b[blo:bhi]]
    return [(k, kind, w + " ") for k, (kind, w) in enumerate(out)]


def replace_once(text: str, old: str, new: str) -> str:
    """``old`` in ``text`` replaced once: literally, else with any whitespace between its words, else the whole text."""
    if old and old in text:
        return text.replace(old, new, 1)
    words = old.split()
    if words:
        hit = re.search(r"\s+".join(map(re.escape, words)), text)
        if hit:
            return text[: hit.start()] + new + text[hit.end() :]
    return new


def in_turn(text: str, olds: list[str], news: list[str], threshold: int) -> tuple[str, list[bool]]:
    """The text after the replacements, one after the other, and which were made: one that the earlier ones left nothing to match for is not."""
    done: list[bool] = []
    for old, new in zip(olds, news):
        fits = not any(done)
        if not fits:
            x, y = " ".join(old.split()), " ".join(text.split())
            fits = (x in y if x else False) or ratio(x, y) >= threshold
        text = replace_once(text, old, new) if fits else text
        done.append(fits)
    return text, done


@F.pandas_udf(IntegerType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)])


@F.pandas_udf(SEGMENTS)
def word_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([[{"ord": k, "kind": kind, "val": val} for k, kind, val in ndiff_words(x, y)] for x, y in zip(old, new)])


@F.pandas_udf(StringType())
def replaced(text: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([replace_once(t or "", o or "", n or "") for t, o, n in zip(text, old, new)])


@F.pandas_udf(StringType())
def replaced_all(text: pd.Series, olds: pd.Series, news: pd.Series) -> pd.Series:
    """The replacements of a text, one after the other."""
    out = []
    for t, a, b in zip(text, olds, news):
        for old, new in zip(a, b):
            t = replace_once(t or "", old, new)
        out.append(t)
    return pd.Series(out)


@F.pandas_udf(StructType([StructField("result", StringType()), StructField("done", ArrayType(BooleanType()))]))
def applied_in_turn(text: pd.Series, olds: pd.Series, news: pd.Series, threshold: pd.Series) -> pd.DataFrame:
    """The replacements of a text, one after the other, and which were made: one that the earlier ones left nothing to match for is not."""
    out = [in_turn(t or "", a, b, least) for t, a, b, least in zip(text, olds, news, threshold)]
    return pd.DataFrame(out, columns=["result", "done"])
