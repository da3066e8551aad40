"""Quality rules learned as a decision list by sequential covering.

Statistics of a document come from built-in functions alone. Labelled
documents (quality 0 or 1) teach an ordered list of rules, each a conjunction
of thresholds on the statistics, that reject. A rule grows by the condition of
the highest information gain on two thirds of the labelled rows and is pruned
on the other third; the documents it covers are set aside and the next rule
grows. The list becomes one ``CASE WHEN`` expression.

Learning looks at all labelled rows, but only ever collects counts per
(statistic, bin): at most features * bins rows a step.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, staged, words

#: Fixed value: the characters counted as symbols.
SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "mean_word", "symbol_rate", "upper_rate", "bang_rate", "digit_rate", "dup_line_rate", "repeat_rate")


def _count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def repeat_words(ws: Column, n: Column, hash_of=F.xxhash64) -> Column:
    """Words that lie in a 3-word window which occurs twice or more in the text.

    A window's hash and position share a long; as many bits as the text's
    length needs are the position's. Sorting brings equal hashes together.
    Neighbours of equal hash are compared word by word; if any two differ, the
    text's windows are sorted by their words instead, so the result never
    depends on the hash. Words are counted from the distances between positions.
    """
    index = F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)).cast("int"))
    before = lambda s, i: F.get(s, i - 1)

    def _gaps(p: Column) -> Column:
        gaps = F.zip_with(F.slice(p, 2, F.size(p)), p, lambda b, a: F.when(b.isNull(), F.lit(0)).otherwise(F.least(F.lit(3), b - a)))
        return F.aggregate(gaps, F.lit(3).cast("long"), lambda acc, g: acc + g.cast("long"))

    def paired(keys: Column, part) -> Column:
        """The sorted keys whose part equals that of a neighbour."""
        same = lambda a, b: a.isNotNull() & (part(a) == part(b))
        return let(F.sort_array(keys), lambda s: F.filter(s, lambda x, i: same(before(s, i), x) | same(F.get(s, i + 1), x)))

    def places(bits: Column) -> Column:
        hash_part = lambda x: F.call_function("shiftright", x, bits)
        position = lambda x: (x - F.call_function("shiftleft", hash_part(x), bits)).cast("int")
        packed = F.transform(index, lambda i: F.call_function("shiftleft", hash_of(ws[i], ws[i + 1], ws[i + 2]), bits).bitwiseOR(i.cast("long")))
        in_words = F.transform(index, lambda i: F.struct(F.struct(ws[i].alias("a"), ws[i + 1].alias("b"), ws[i + 2].alias("c")).alias("w"), i.alias("p")))

        def verified(s: Column) -> Column:
            differ = lambda p, q: (ws[p] != ws[q]) | (ws[p + 1] != ws[q + 1]) | (ws[p + 2] != ws[q + 2])
            clash = F.transform(s, lambda x, i: (before(s, i).isNotNull()) & (hash_part(before(s, i)) == hash_part(x)) & differ(position(before(s, i)), position(x)))
            exact = F.transform(paired(in_words, lambda x: x["w"]), lambda x: x["p"])
            return F.when(F.array_contains(clash, True), exact).otherwise(F.transform(s, position))

        return let(paired(packed, hash_part), verified)

    found = let(F.length(F.bin(n)), places)
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(found, lambda s: F.when(F.size(s) == 0, F.lit(0).cast("long")).otherwise(let(F.sort_array(s), _gaps))))


#: Labelled documents that `kept_documents` learns from, at most.
MAX_LABELLED = 20_000


def statistics(docs: DataFrame, *carry: Column) -> DataFrame:
    """doc_id and the statistics of every whole text. A null text counts as empty; all its statistics are 0.

    ``carry``: aliased columns that come along.
    """
    t = F.col("__qm_text")
    df = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("__qm_text"), *carry)
    carried = [c for c in df.columns if c not in ("doc_id", "__qm_text")]
    df = df.withColumn("__qm_words", words(t))
    df = df.withColumn("n_words", F.when(F.btrim(t, F.lit(SPACES)) == "", F.lit(0)).otherwise(F.size("__qm_words")).cast("long"))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = df.withColumn("__qm_lines", lines)
    return df.select(
        "doc_id",
        "n_words",
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        _count_chars(t, SYMBOLS).alias("n_symbols"),
        F.size("__qm_lines").cast("long").alias("n_lines"),
        (F.size("__qm_lines") - F.size(F.array_distinct("__qm_lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("__qm_words"), F.col("n_words")).alias("n_repeat_words"),
        _count_chars(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        _count_chars(t, "!").alias("n_bang"),
        _count_chars(t, "0123456789").alias("n_digits"),
        *carried,
    )


def base_failed() -> Column:
    """Fixed rule: under 50 words, or more than half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    """The statistics that conditions may test, as rates; 0 where there is nothing to divide by."""
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": rate("word_chars", "n_words"),
        "symbol_rate": rate("n_symbols", "word_chars"),
        "upper_rate": rate("n_upper", "word_chars"),
        "bang_rate": rate("n_bang", "n_words"),
        "digit_rate": rate("n_digits", "word_chars"),
        "dup_line_rate": rate("n_dup_lines", "n_lines"),
        "repeat_rate": rate("n_repeat_words", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def sql(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}"


@dataclass
class DecisionList:
    """Ordered rules; the first that holds rejects, otherwise the document is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def rejects(self) -> Column:
        out = None
        for rule in self.rules:
            test = F.lit(True)
            for c in rule:
                test = test & c.column()
            out = F.when(test, True) if out is None else out.when(test, True)
        return F.lit(False) if out is None else out.otherwise(False)

    def sql(self) -> str:
        return "CASE " + " ".join("WHEN " + " AND ".join(c.sql() for c in rule) + " THEN false" for rule in self.rules) + " ELSE true END" if self.rules else "true"


def learn(labelled: DataFrame, bins: int = 32, max_rules: int = 8, max_conditions: int = 4, min_precision: float = 0.9, min_cover: int = 5) -> DecisionList:
    """Sequential covering over ``labelled`` (FEATURES as doubles, ``bad`` int, ``prune`` boolean).

    Ties in gain go to the condition that sorts first. Without labelled rows,
    or with one class only, the list is empty and rejects nothing.
    """
    cuts_row = labelled.agg(*[F.percentile_approx(f, [i / bins for i in range(1, bins)], 10000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(cuts_row[f] or [])) for f in FEATURES}
    if not any(cuts.values()):
        return DecisionList()

    def bin_of(f: str) -> Column:
        """Number of cuts below the value: x > cuts[k] holds exactly for bins above k."""
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts[f]]), lambda c: c < F.col(f)))

    binned = labelled.select("bad", "prune", *FEATURES, F.array(*[F.struct(F.lit(i).alias("f"), bin_of(f).alias("b")) for i, f in enumerate(FEATURES)]).alias("__qm_bins"))
    binned = staged(binned, "quality-labelled")
    learned = DecisionList()
    for _ in range(max_rules):
        left = binned.filter(~learned.rejects())
        grow = left.filter(~F.col("prune"))
        rule: list[Condition] = []
        for _ in range(max_conditions):
            inside = grow
            for c in rule:
                inside = inside.filter(c.column())
            counts = inside.select("bad", F.explode("__qm_bins").alias("x")).groupBy("x.f", "x.b").agg(F.sum("bad").alias("p"), F.count("*").alias("n")).collect()
            best = _best(counts, cuts, rule, min_cover)
            if best is None:
                break
            rule.append(best)
        if not rule:
            break
        rule = _pruned(left.filter("prune"), rule)
        scope = left
        for c in rule:
            scope = scope.filter(c.column())
        got = scope.agg(F.sum("bad").alias("p"), F.count("*").alias("n"), F.sum(F.when(F.col("prune"), F.col("bad"))).alias("pp"), F.count(F.when(F.col("prune"), 1)).alias("pn")).first()
        if got["n"] < min_cover or got["p"] < min_precision * got["n"] or (got["pn"] and (got["pp"] or 0) < min_precision * got["pn"]):
            break
        learned.rules.append(_centred(left, rule))
    return learned


def _centred(rows: DataFrame, rule: list[Condition]) -> list[Condition]:
    """The rule with each threshold in the middle between the values next to it on
    either side: bins end at observed values, and a threshold at one would
    decide alike only for values never seen in between."""
    aggs = []
    for k, c in enumerate(rule):
        value = F.col(c.feature)
        aggs += [F.max(F.when(value <= c.threshold, value)).alias(f"a{k}"), F.min(F.when(value > c.threshold, value)).alias(f"b{k}")]
    got = rows.agg(*aggs).first()
    middle = lambda k, c: c.threshold if got[f"a{k}"] is None or got[f"b{k}"] is None else (got[f"a{k}"] + got[f"b{k}"]) / 2
    return [Condition(c.feature, c.above, middle(k, c)) for k, c in enumerate(rule)]


def _best(counts: list, cuts: dict, rule: list[Condition], min_cover: int) -> Condition | None:
    """The condition of the highest FOIL gain, given counts per (feature, bin)."""
    table: dict[int, dict[int, tuple[int, int]]] = {}
    for r in counts:
        table.setdefault(r["f"], {})[r["b"]] = (r["p"], r["n"])
    found = None
    for i, f in enumerate(FEATURES):
        rows = table.get(i, {})
        p0, n0 = sum(p for p, _ in rows.values()), sum(n for _, n in rows.values())
        if not p0 or p0 == n0:
            continue
        p = n = 0
        for k, cut in enumerate(cuts[f]):
            p, n = p + rows.get(k, (0, 0))[0], n + rows.get(k, (0, 0))[1]
            for above, pos, all_ in ((False, p, n), (True, p0 - p, n0 - n)):
                if pos >= min_cover and all_ < n0:
                    gain = pos * (math.log2(pos / all_) - math.log2(p0 / n0))
                    c = Condition(f, above, cut)
                    if gain > 1e-9 and c not in rule and (found is None or gain > found[0] + 1e-12):
                        found = (gain, c)
    return found and found[1]


def _pruned(rows: DataFrame, rule: list[Condition]) -> list[Condition]:
    """The prefix of the rule with the best (p - n) / (p + n) on rows that it did not grow on; the longest of equals."""
    aggs, test = [], F.lit(True)
    for k, c in enumerate(rule):
        test = test & c.column()
        aggs += [F.coalesce(F.sum(F.when(test, F.col("bad"))), F.lit(0)).alias(f"p{k}"), F.count(F.when(test, 1)).alias(f"n{k}")]
    got = rows.agg(*aggs).first()
    worth = [(2 * got[f"p{k}"] - got[f"n{k}"]) / got[f"n{k}"] if got[f"n{k}"] else -1.0 for k in range(len(rule))]
    best = max(range(len(rule)), key=lambda k: (worth[k], k))
    return rule[: best + 1]


def learn_from(stats: DataFrame, labels: DataFrame, **options) -> DecisionList:
    """Join the statistics with the labels (lowest quality of a repeated id; null labels do not teach) and learn.

    Documents that the base rule rejects do not teach: no learned rule decides on them.
    """
    marks = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("__qm_id")).agg(F.min("quality").alias("__qm_quality"))
    rows = stats.filter(~base_failed()).join(marks, stats["doc_id"] == marks["__qm_id"])
    return learn(rows.select(*[c.alias(f) for f, c in features().items()], (F.col("__qm_quality") == 0).cast("int").alias("bad"), (F.pmod(F.xxhash64(stats["doc_id"]), F.lit(3)) == 0).alias("prune")), **options)


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Statistics, base rule and verdict of every document.

    The statistics are staged, so the texts are read once. A document that
    fails the base rule is not kept; any other is kept unless a learned rule
    rejects it.
    """
    stats = staged(statistics(docs), "quality-stats")
    return _decided(stats, learn_from(stats, labels, **options))


def _decided(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """``stats`` with base_failed and kept."""
    failed = base_failed()
    wide = stats.select("*", *[c.alias(f"__qm_{f}") for f, c in features().items()])
    renamed = DecisionList([[Condition(f"__qm_{c.feature}", c.above, c.threshold) for c in r] for r in rules.rules])
    return wide.select(*stats.columns, failed.alias("base_failed"), (~failed & ~renamed.rejects()).alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with all columns, decided where they are read: no join, no shuffle of texts.

    The rules are learned from MAX_LABELLED labelled documents at most (the
    smallest hashes of ids; their ids are broadcast), so that the texts of all
    documents are analysed once.
    """
    usable = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("__qm_id")).agg(F.min("quality").alias("quality"))
    sample = staged(usable.orderBy(F.xxhash64("__qm_id"), "__qm_id").limit(MAX_LABELLED), "quality-sample")
    marked = docs.select("doc_id", "text").join(F.broadcast(sample.select("__qm_id")), docs["doc_id"].cast("long") == F.col("__qm_id"), "left_semi")
    rules = learn_from(staged(statistics(marked), "quality-stats"), sample.withColumnRenamed("__qm_id", "doc_id"), **options)
    decided = _decided(statistics(docs, F.struct(*[docs[c] for c in docs.columns]).alias("__qm_row")), rules)
    # a generator keeps Catalyst from pushing the filter down, where it would compute the statistics once per mention
    return decided.select("__qm_row", F.inline(F.array(F.struct(F.col("kept").alias("__qm_kept"))))).filter("__qm_kept").select("__qm_row.*")
