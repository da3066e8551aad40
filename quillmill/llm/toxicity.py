"""Toxicity of texts that hide their words: noisy-channel decoding, then scoring.

A token that could have been written otherwise (digits or symbols for letters,
letters repeated or kept apart) is a lattice: each character may stand for one
of several letters, or for nothing. A run of SPACED or more tokens of one
character is one lattice, too: each blank in it is either left out, or the end
of a word. Viterbi search finds the reading that is cheapest under the
channel's costs and a character trigram model, which is counted over the words
of the whole corpus. A token whose lattice has a single
path is left as it is, without a search: that is the same result. So is a token
without a letter, if one of its characters stands for no letter (2024): no
reading of it is a word. Marks at a token's edges that may be letters are read
both ways (idiot!, a$$); the token counts as both words.

Restored words, their beginnings and the character n-grams in them are weighed by their log odds
in toxic and other labelled documents, with a lower confidence bound, so that
only well supported ones count; copies of a text count as one. Every feature is counted by itself. A document's sum of weights over distinct
words, and its strongest weight, are turned into a probability by logistic
calibration on labelled documents that the weights have not seen. Learning uses MAX_LABELLED labelled documents at most,
the ones with the smallest hash of their id, and none with remainder 0.

Texts are cut into words batch by batch in Arrow, and every distinct word of a
batch is looked at once. Time grows with the length of the texts; no word is cut.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged

#: Labelled documents that the classifier is fitted on, at most.
MAX_LABELLED = 20_000
#: Toxic documents that a feature must be in to count.
LEAST = 4
GRAM = 5
#: Letters of the beginnings that are features.
BEGINNINGS = (5, 6, 7, 8)
#: Words that a task remembers.
MEMORY = 400_000

#: What a character may stand for, and what may stand between letters.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou"}
BETWEEN = ".-_*~,'`^"
#: Channel costs in nats: another letter than written, a character left out, a repeated letter left out.
OTHER, LEFT_OUT, REPEATED = 1.0, 0.5, 0.2
#: Costs in a spaced run: a blank left out, a blank that ends a word; tokens of one character that make a run.
JOINED, ENDED, SPACED = 0.1, 1.0, 3
#: Letters of the character model besides a to z.
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz") | frozenset(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)

#: Marks that stay at a token's front and back when the others are taken off, and all that may be letters.
FRONT, BACK, MAYBE = "@$", "@+", "".join(LEET)
MARKS = re.compile(r"\W*")
TWICE = re.compile(r"(.)\1")


def trimmed(token: str, front: str, back: str) -> str:
    """The token without the marks at its edges, but for those named."""
    i, j = 0, len(token)
    while i < j and not (token[i].isalnum() or token[i] == "_" or token[i] in front):
        i += 1
    while j > i and not (token[j - 1].isalnum() or token[j - 1] == "_" or token[j - 1] in back):
        j -= 1
    return token[i:j]


class CharModel:
    """Trigram model with interpolation, from counts of padded trigrams."""

    def __init__(self, counts: dict[str, int]):
        self.tri = counts
        self.ctx: dict[str, int] = {}
        self.uni: dict[str, int] = {}
        for g, n in counts.items():
            self.ctx[g[:2]] = self.ctx.get(g[:2], 0) + n
            self.uni[g[2]] = self.uni.get(g[2], 0) + n
        self.total = sum(self.uni.values())
        self.known: dict[str, float] = {}
        self.read: dict[str, str] = {}

    def cost(self, context: str, c: str) -> float:
        """Negative log probability of a character (or the end, ``$``) after two."""
        gram = context + c
        if (out := self.known.get(gram)) is None:
            base = (self.uni.get(c, 0) + 0.5) / (self.total + 30)
            n = self.ctx.get(context, 0)
            if len(self.known) > MEMORY:
                self.known.clear()
            out = self.known[gram] = -math.log((self.tri.get(gram, 0) + 8 * base) / (n + 8))
        return out

    def _doubles(self, token: str) -> str | None:
        """The same for letters that hold but doubled ones, each far enough from the next to be decided by itself; else None."""
        at = [k for k in range(1, len(token)) if token[k] == token[k - 1]]
        if any(b - a < 4 for a, b in zip(at, at[1:])):
            return None
        for k in reversed(at):
            # the trigrams that hold the letter, or those that close the gap
            around = f"^^{token}$"[k : k + 5]
            without = around[:2] + around[3:]
            kept, left_out = (sum(self.cost(t[j : j + 2], t[j + 2]) for j in range(len(t) - 2)) for t in (around, without))
            if REPEATED + left_out < kept:
                token = token[:k] + token[k + 1 :]
        return token

    def restore(self, token: str) -> str:
        """The cheapest reading of a token (lower case): exact Viterbi search over the last two letters.

        A blank is a gap in a spaced run; the reading then is of one or more words.
        """
        if token.isalpha() and (out := self._doubles(token)) is not None:
            return out
        # a state: what it cost, and its letters as (what came before, letter); of equal costs the first found stays
        states: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
        previous = ""
        known, cost_of = self.known, self.cost
        for ch in token:
            nxt: dict[str, tuple[float, tuple | None]] = {}
            if ch == " ":
                # left out, or the end of a word and the beginning of another
                for context, (cost, text) in states.items():
                    if context not in nxt or cost + JOINED < nxt[context][0]:
                        nxt[context] = (cost + JOINED, text)
                    if context != "^^":
                        c = cost + ENDED + cost_of(context, "$")
                        if "^^" not in nxt or c < nxt["^^"][0]:
                            nxt["^^"] = (c, (text, " "))
                states = nxt
                continue
            choices = [(o, OTHER) for o in LEET.get(ch, "")]
            if ch.isalpha():
                choices.append((ch, 0.0))
            elif not choices and ch not in BETWEEN:
                choices.append((ch, 0.0))
            skip = REPEATED if ch == previous else LEFT_OUT if ch in BETWEEN else None
            for context, (cost, text) in states.items():
                for o, price in choices:
                    c = known.get(context + o)
                    c = cost + price + (cost_of(context, o) if c is None else c)
                    key = context[1] + o
                    if key not in nxt or c < nxt[key][0]:
                        nxt[key] = (c, (text, o))
                if skip is not None:
                    c = cost + skip
                    if context not in nxt or c < nxt[context][0]:
                        nxt[context] = (c, text)
            states, previous = nxt, ch
        text = min(((cost + self.cost(context, "$"), k, text) for k, (context, (cost, text)) in enumerate(states.items())), key=lambda x: x[:2])[2]
        out = []
        while text is not None:
            text, o = text
            out.append(o)
        return "".join(reversed(out))


def hidden(token: str) -> bool:
    """Whether the lattice of a token has more than one path."""
    if token.isalpha():
        return TWICE.search(token) is not None
    return " " in token or any(c.isalpha() for c in token) or all(c in LEET or c in BETWEEN for c in token)


def single(token: str) -> bool:
    """Whether a token may be a letter of a spaced run."""
    return len(token) == 1 and (token.isalnum() or token in LEET)


def words_of(column) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words of the texts of an Arrow column, in lower case: (text, number of the word) in order, and the words by number.

    A run of SPACED or more tokens of one character is one word, with a blank between the letters.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))))
    text = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    coded = lists.flatten().dictionary_encode()
    code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    full = np.array([bool(w) for w in words], dtype=bool)[code] if words else np.zeros(0, dtype=bool)
    text, code = text[full], code[full]
    alone = np.array([single(w) for w in words], dtype=bool)[code] if words else full
    # bounds of runs of single characters within a text
    change = np.ones(len(code) + 1, dtype=bool)
    change[1:-1] = (alone[1:] != alone[:-1]) | (text[1:] != text[:-1])
    bounds = np.flatnonzero(change)
    lo, hi = bounds[:-1], bounds[1:]
    runs = np.flatnonzero((hi - lo >= SPACED) & alone[lo]) if len(lo) else []
    if len(runs):
        stays, known = np.ones(len(code), dtype=bool), {}
        for r in runs:
            word = " ".join([words[c] for c in code[lo[r] : hi[r]]])
            if word not in known:
                known[word] = len(words)
                words.append(word)
            stays[lo[r] + 1 : hi[r]] = False
            code[lo[r]] = known[word]
        text, code = text[stays], code[stays]
    return text, code, words


def tokens_of(text: str | None) -> set[str]:
    """Distinct words of a text."""
    import pyarrow as pa

    _, code, words = words_of(pa.array([text], pa.large_string()))
    return {words[c] for c in code}


def _read(core: str, model: CharModel) -> str:
    if not core or not hidden(core):
        return core
    if (out := model.read.get(core)) is None:
        if len(model.read) > MEMORY // 4:
            model.read.clear()
        out = model.read[core] = model.restore(core)
    return out


def restored(token: str, model: CharModel) -> str:
    """The reading without the marks at the edges."""
    return _read(token if token.isalpha() else trimmed(token, FRONT, BACK), model)


def readings(token: str, model: CharModel) -> set[str]:
    """The words that a token may be: at each edge without the marks that may be letters, with those equal to the next one, or with all.

    Letters count as written, too: a doubled one may belong there. A spaced run
    gives the words of its cheapest reading, and the cheapest reading without
    any blank: three letters of context do not always tell where a word ends.
    """
    if token.isalpha() and not TWICE.search(token):
        return {token}
    if " " in token:
        whole = token.replace(" ", "")
        return {*_read(token, model).split(" "), _read(whole, model), whole if whole.isalpha() else ""} - {""}
    bare = token if token.isalpha() else trimmed(token, MAYBE, MAYBE)
    cores = {bare}
    if not bare.isalpha():
        cores.add(trimmed(token, FRONT, BACK))
        begin, end = MARKS.match(bare).end(), len(bare) - MARKS.match(bare[::-1]).end()
        if begin < end:
            front, back = bare[:begin], bare[end:]
            begins = {0, begin, len(front.rstrip(front[-1:]) if front else "")}
            ends = {len(bare), end, len(bare) - len(back.lstrip(back[:1]) if back else "")}
            cores.update(bare[i:j] for i in begins for j in ends)
    return {bare if bare.isalpha() else "", *(_read(c, model) for c in cores)} - {""}


def features(word: str) -> set[str]:
    """A restored word, its beginnings and its character n-grams. Marks keep them apart where their letters are equal."""
    padded = f"^{word}$"
    return {f"={word}", *(f"<{word[:k]}" for k in BEGINNINGS if k < len(word)), *(padded[k : k + GRAM] for k in range(len(padded) - GRAM + 1))}


@dataclass
class Classifier:
    weights: dict[str, float] = field(default_factory=dict)
    coefficients: tuple[float, ...] = (-3.0, 0.0, 0.0, 0.0)

    known: dict[str, float] = field(default_factory=dict)

    def word_weight(self, word: str) -> float:
        """The heaviest feature of a restored word."""
        if (out := self.known.get(word)) is None:
            if len(self.known) > MEMORY:
                self.known.clear()
            get = self.weights.get
            out = self.known[word] = max((get(f, 0.0) for f in features(word)), default=0.0) if word else 0.0
        return out

    def weigh_all(self, words: list[str]) -> None:
        """Remember the weights of words; those in which no weighted feature can be are found all at once, by hashes of n-grams."""
        words = [w for w in words if w not in self.known]
        if len(self.known) + len(words) > MEMORY:
            self.known.clear()
        grams = [f for f in self.weights if len(f) == GRAM and f[0] not in "=<"]
        heads = {f[1:6] for f in self.weights if f[0] == "<"}
        whole = {f[1:] for f in self.weights if f[0] == "="}
        text = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        wanted = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(-1, GRAM)
        met = np.isin(_gram_hash([text[k : len(text) - GRAM + 1 + k] for k in range(GRAM)]), _gram_hash(list(wanted.T))) if len(text) >= GRAM else np.zeros(0, dtype=bool)
        ends = np.cumsum([len(w) + 2 for w in words], dtype=np.int64)
        may = np.zeros(len(words), dtype=bool)
        may[np.searchsorted(ends, np.flatnonzero(met), side="right")] = True
        for w, m in zip(words, may.tolist()):
            if not m and w[:5] not in heads and w not in whole:
                self.known[w] = 0.0

    def score(self, total: float, strongest: float, distinct: int) -> float:
        a, b, c, d = self.coefficients
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * math.log1p(total) + c * total / math.sqrt(distinct + 10) + d * strongest))))


def _gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        out = out * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) + np.uint64(1)
    return out


def _distinct(text: np.ndarray, code: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, word) of a batch, sorted."""
    pairs = np.sort(text * max(1, words) + code)
    fresh = np.ones(len(pairs), dtype=bool)
    fresh[1:] = pairs[1:] != pairs[:-1]
    return np.divmod(pairs[fresh], max(1, words))


def weight_of(a: Column, b: Column, toxic: float, other: float, z: float = 3.0) -> Column:
    """Lower confidence bound of the log odds of a feature in ``a`` of ``toxic`` documents and ``b`` of ``other`` ones; fractions allowed."""
    spread = F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) - 1 / (toxic + 1) - 1 / (other + 1))
    return F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (other + 1)) - z * spread


def calibrate(rows: list[tuple[float, float, int, int]]) -> tuple[float, ...]:
    """Logistic regression (Newton, small ridge) of labels on the weights. rows: (total, strongest, distinct words, label)."""
    if not rows or len({r[3] for r in rows}) < 2:
        return Classifier().coefficients
    total, strongest, distinct, y = (np.array(c, dtype=float) for c in zip(*rows))
    x = np.column_stack([np.ones(len(y)), np.log1p(total), total / np.sqrt(distinct + 10), strongest])
    use = np.ones(4, dtype=bool)
    while True:
        w, ridge = np.zeros(4), np.array([0, 0.05, 0.05, 0.05])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            z = x[:, use]
            w[use] += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge[use] + 1e-6), z.T @ (y - p) - (ridge * w)[use])
        if (w[1:] >= 0).all():
            return tuple(float(v) for v in w)
        # more weight must never lower a score: leave the worst term out
        use[1 + int(np.argmin(w[1:]))] = False


def _count_trigrams(batches):
    import pyarrow as pa

    grams: dict[str, int] = {}
    for batch in batches:
        _, code, words = words_of(batch.column(0))
        for w, n in zip(words, np.bincount(code, minlength=len(words)).tolist()):
            w = w if w.isalpha() else trimmed(w, FRONT, BACK)
            if n and w and LETTERS.issuperset(w):
                padded = f"^^{w}$"
                for k in range(len(padded) - 2):
                    gram = padded[k : k + 3]
                    grams[gram] = grams.get(gram, 0) + n
    yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], names=["gram", "n"])


def char_model(docs: DataFrame) -> CharModel:
    """The model over all words of all documents. Its trigrams are over a fixed alphabet, so their number is bounded."""
    rows = docs.select(docs["text"].cast("string").alias("text")).mapInArrow(_count_trigrams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return CharModel({r["gram"]: r["n"] for r in rows})


def _parts(text: np.ndarray, code: np.ndarray, texts: int, words: int) -> list[np.ndarray]:
    """The distinct words of each text, by number."""
    owner, word = _distinct(text, code, words)
    return np.split(word, np.searchsorted(owner, np.arange(1, texts)))


def _families(batches):
    """(part, label, text) with ``family``: the smallest hashes of its words, which copies have in common, near copies mostly."""
    import pyarrow as pa

    for batch in batches:
        text, code, words = words_of(batch.column(2))
        hashes = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.int64)
        families = [zlib.crc32(np.sort(hashes[found])[:4].tobytes()) for found in _parts(text, code, batch.num_rows, len(words))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2).cast(pa.string()), pa.array(families, pa.int64())], names=["part", "label", "text", "family"])


def _count_features(shared):
    """(feature, in toxic documents, in others) from (label, weight, text), one row per batch and feature."""

    def run(batches):
        import pyarrow as pa

        lm = CharModel(shared.value)
        for batch in batches:
            text, code, words = words_of(batch.column(2))
            number: dict[str, int] = {}
            of_word = [np.array([number.setdefault(f, len(number)) for w in readings(t, lm) for f in features(w)], dtype=np.int64) for t in words]
            counts = np.zeros((2, len(number)))
            for label, weight, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _parts(text, code, batch.num_rows, len(words))):
                if len(found):
                    counts[label, np.unique(np.concatenate([of_word[c] for c in found]))] += weight
            yield pa.RecordBatch.from_arrays([pa.array(list(number), pa.string()), pa.array(counts[1], pa.float64()), pa.array(counts[0], pa.float64())], names=["feature", "toxic", "other"])

    return run


def _totals(column, classifier: Classifier, model: CharModel, memory: dict) -> list[tuple[float, float, int]]:
    """Sum and maximum of the weights of each text's distinct restored words, and the number of its distinct words."""
    text, code, words = words_of(column)
    if len(memory) > MEMORY:
        memory.clear()  # the batch's words are looked up again below
    fresh = [(t, readings(t, model)) for t in words if t not in memory]
    classifier.weigh_all(list(set().union(*(r for _, r in fresh))) if fresh else [])
    for t, found in fresh:
        read = [(weight, w) for w in found if (weight := classifier.word_weight(w)) > 0]
        if len(read) > 1:
            # the words of a spaced run stand beside each other (of words in each other the heavier counts), the readings of any other token instead of each other
            read = [x for x in read if not any(x[1] != y[1] and x[1] in y[1] and y[0] >= x[0] for y in read)] if " " in t else [max(read)]
        memory[t] = tuple(read)
    weighed = np.array([bool(memory[t]) for t in words], dtype=bool)
    owner, word = _distinct(text, code, len(words))
    distinct = np.bincount(owner, minlength=len(column))
    found: dict[int, dict[str, float]] = {}
    for o, c in zip(owner[weighed[word]].tolist(), word[weighed[word]].tolist()):
        mine = found.setdefault(o, {})
        for weight, w in memory[words[c]]:
            mine[w] = weight
    out = []
    for o in range(len(column)):
        mine = found.get(o, {})
        out.append((sum(mine[w] for w in sorted(mine)), max(mine.values(), default=0.0), int(distinct[o])))
    return out


def _held_totals(shared):
    def run(batches):
        import pyarrow as pa

        # plain data is broadcast; the classes are put around it here
        weights, coefficients, counts = shared.value
        classifier, model = Classifier(weights, coefficients), CharModel(counts)
        memory: dict = {}
        for batch in batches:
            got = _totals(batch.column(1), classifier, model, memory)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int64())], names=["label", "total", "strongest", "distinct"])

    return run


def _score(shared):
    def run(batches):
        import pyarrow as pa

        # plain data is broadcast; the classes are put around it here
        weights, coefficients, counts = shared.value
        classifier, model = Classifier(weights, coefficients), CharModel(counts)
        memory: dict = {}
        for batch in batches:
            scores = [classifier.score(*got) for got in _totals(batch.column(1), classifier, model, memory)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, model: CharModel) -> Classifier:
    """Weights from the folds 1 to 3, calibration from fold 4 of the labelled sample; fold 0 is never read.

    The labels of a repeated id are one label, the highest. Without toxic
    examples every text gets the same low score.
    """
    spark = docs.sparkSession
    marks = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(fold(F.col("doc_id")) != 0).groupBy(F.col("doc_id").cast("long").alias("__qm_id")).agg(F.max("toxic").cast("int").alias("label"))
    sample = marks.orderBy(F.xxhash64("__qm_id"), "__qm_id").limit(MAX_LABELLED).withColumn("part", (fold(F.col("__qm_id")) == 4).cast("int"))
    sample = staged(sample, "tox-sample")
    slim = docs.select(docs["doc_id"].cast("long").alias("__qm_doc"), docs["text"].cast("string").alias("text"))
    rows = slim.join(F.broadcast(sample), F.col("__qm_doc") == F.col("__qm_id")).select("part", "label", "text")
    seen = staged(rows.mapInArrow(_families, "part int, label int, text string, family long"), "tox-sample-texts")
    part = seen.filter("part = 0")
    # texts of a family share one vote, so a text's words are not toxic for having been copied; at most MAX_LABELLED families are broadcast
    shares = part.groupBy("label", "family").agg((1.0 / F.count("*")).alias("weight"))
    taught = part.join(F.broadcast(shares), ["label", "family"]).select("label", "weight", "text")
    sizes = {r["label"]: r["n"] for r in taught.groupBy("label").agg(F.round(F.sum("weight"), 6).alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    lm = spark.sparkContext.broadcast(model.tri)
    sums = [F.round(F.sum("toxic"), 6).alias("a"), F.round(F.sum("other"), 6).alias("b")]
    counts = taught.mapInArrow(_count_features(lm), "feature string, toxic double, other double").groupBy("feature").agg(*sums).filter(F.col("a") >= LEAST)
    # only features that speak for toxicity reach the driver
    weights = {r["feature"]: r["w"] for r in counts.select("feature", weight_of(F.col("a"), F.col("b"), float(toxic), float(other)).alias("w")).filter("w > 0").orderBy("feature").collect()}
    bare = spark.sparkContext.broadcast((weights, Classifier().coefficients, model.tri))
    held = seen.filter("part = 1").select("label", "text").mapInArrow(_held_totals(bare), "label int, total double, strongest double, distinct long").collect()
    return Classifier(weights, calibrate(sorted((r["total"], r["strongest"], r["distinct"], r["label"]) for r in held)))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``; null texts score as empty ones."""
    model = char_model(small_batches(docs))
    classifier = fit(docs, labels, model)
    shared = docs.sparkSession.sparkContext.broadcast((classifier.weights, classifier.coefficients, model.tri))
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    scored = slim.mapInArrow(_score(shared), "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
