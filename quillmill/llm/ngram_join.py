"""N-gram Jaccard join with prefixes of token combinations.

A document's set is its distinct word shingles ("tokens" below). Documents
whose sets reach the similarity are linked; the result names the component of
every document. All of it is exact up to 64-bit hashes of shingles and 128-bit ones of sets.

1. One pass stages (doc_id, set size, set hash). Equal sets are one node from
   here on, so copies, however many, are joined by their hash alone. A node's
   name is half of that hash; of sets that share a half (some three pairs among
   10^10 sets) the other half is taken. The same
   pass counts tokens that occur twice in a part of a task's documents; the
   most frequent of them (a bounded number) make up the class of frequent
   tokens. The class only steers the order of tokens and never decides a link.
2. Tokens are ordered from rare to frequent. Two linked sets share a token in
   their prefixes of length n - ceil(t n) + 1. If the first shared token is
   rare, the index of single rare prefix tokens finds the pair; if both prefixes
   (longer by COMMON - 1 tokens) hold rare tokens only, the pair must even meet
   COMMON times, which rids it of chance meetings. If it is
   frequent, all shared tokens are. Then prefixes are extended until they hold
   at least D + 2 shared tokens, where D bounds the tokens that only one of the
   two has. As each of those can separate one neighbouring pair of shared
   tokens at most, two shared tokens are neighbours in both lists: the index of
   2-token combinations of neighbouring frequent tokens finds the pair.
3. Groups of up to PAIR_GROUP nodes with a rare token in common give candidate
   pairs of compatible sizes. Larger groups, and all groups of combinations,
   would give pairs by the square of their size: they only say which nodes
   belong to a family (connected components over one edge per member).
4. A family is described by how its sets differ from a base, the tokens that
   most of a drawn number of them have: D(x) is what x has and the base has
   not, or the reverse. As x and y differ by |D(x)| + |D(y)| - 2 |D(x) and D(y)|
   tokens, they are linked exactly if f(x) + f(y) <= 2 (den + num) |D(x) and D(y)|
   with f(x) = (den + num) |D(x)| - (den - num) |x|. So the set of the least f is
   linked to every x with f(x) + f <= 0, without any comparison, and these are
   all pairs that need no token in common: one edge a member. Each pair that is
   left has a member beyond that bound and shares tokens of D. Tokens of one
   member only are put aside; from how many tokens are left to a member, and the
   least f among those of as many, follows how many it must share at least, if
   it can at all, and a prefix index over what is left finds the candidates. A group of more
   than PAIR_GROUP members with a token is a smaller family with a base of
   its own. It has to find the pairs whose first common token that is, so what
   stands behind it are its sets, and the token itself is paid for in f:
   no pair is looked for twice, and sets get shorter until the rounds end. The
   base only steers the work: the outcome is exact for any.
5. Candidates are verified on whole sets, and the links' components named.

Rows with a null doc_id have no component and link nothing; null or wordless
texts have an empty set and are alone. A repeated doc_id is one document as
far as its sets are equal; otherwise its rows are separate texts with one name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged
from .components import connected_components

#: Nodes that may share a rare token before the group is treated as a family.
PAIR_GROUP = 64
#: Estimated documents from which on a token counts as frequent, and the size of that class at most (12 bytes each are broadcast).
FREQUENT, CLASS_SIZE = 16, 1 << 20
#: Tokens that a task counts at a time when it looks for frequent ones.
COUNT_TOKENS = 4_000_000
#: Tokens that two sets with prefixes of rare tokens must share there.
COMMON = 3
#: Members that a family's base is taken from, about; members of a family in a part, which the base is sent to.
DRAWN, PART = 64, 2048
#: Rounds that no input needs: in each, sets lose their first token and what stands before it, and groups are of few members.
ROUNDS = 64
#: Parts of a large group of combinations, and of a family for what all its members need.
SALT = 16
#: Sets of at most this size are indexed by all their tokens.
TINY = 8

FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Spec:
    """Words per shingle, and the similarity as a fraction."""

    words: int = 4
    num: int = 85
    den: int = 100

    def linked(self, shared, a, b):
        return self.den * shared >= self.num * (a + b - shared)

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    @property
    def common(self) -> int:
        """Tokens to share in the prefixes: COMMON, or as many as any two different linked sets share."""
        return COMMON if self.num == self.den else min(COMMON, max(1, -(-self.num // (self.den - self.num))))

    def extended(self, n: int) -> int:
        """Length of the prefix that holds D + 2 shared tokens for every D possible."""
        return self.prefix(n) + 1 + (self.den - self.num) * n // self.num


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection, so different inputs stay different."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def token_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    ws = text.translate(FOLD).split() if text else []
    if not ws:
        return np.zeros(0, dtype=np.uint64)
    if len(ws) < k:
        return np.array([h(b" ".join(ws), seed=len(ws))], dtype=np.uint64)
    a = np.array([h(w) for w in ws], dtype=np.uint64)
    n = len(a) - k + 1
    out = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + a[j : j + n])
    return np.unique(out)


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return h & (2**64 - 1), h >> 64


def node_of(tokens: np.ndarray, clashes: frozenset = frozenset()) -> tuple[int, int]:
    """A set's node and the other half of its hash, as signed numbers. ``clashes``: nodes of more than one set."""
    node, check = (x - 2**64 if x >> 63 else x for x in _digest(tokens))
    return (check if node in clashes else node), check


def _texts(batch):
    import pyarrow as pa

    column = batch.column(1)
    return (x.as_py() for x in (column if pa.types.is_large_binary(column.type) else column.cast(pa.large_binary())))


def _profile(spec: Spec):
    """Per document (0, doc_id, n, node, check); per frequent token of a part of the task (1, token, count, nulls)."""

    def run(batches):
        import pyarrow as pa

        names = ["kind", "id", "n", "node", "check"]
        sets: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def counts():
            tokens, times = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
            often = times >= 2
            return pa.RecordBatch.from_arrays([pa.array(np.ones(int(often.sum()), dtype=np.int32)), pa.array(tokens[often].view(np.int64)), pa.array(times[often].astype(np.int64)), pa.nulls(int(often.sum()), pa.int64()), pa.nulls(int(often.sum()), pa.int64())], names=names)

        for batch in batches:
            ids, ns, nodes, checks = batch.column(0).cast(pa.int64()), [], [], []
            for text in _texts(batch):
                s = token_set(text, spec.words)
                node, check = node_of(s) if len(s) else (None, None)
                ns.append(len(s))
                nodes.append(node)
                checks.append(check)
                if len(s) and node not in seen:
                    seen.add(node)
                    sets.append(s)
                    size += len(s)
                if size >= COUNT_TOKENS:
                    yield counts()
                    sets, seen, size = [], set(), 0
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ns), dtype=np.int32)), ids, pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64())], names=names)
        yield counts()

    return run


def signatures(tokens: np.ndarray, spec: Spec, often: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Single rare tokens and combinations of neighbouring frequent ones to index a set by.

    The last value tells whether the singles are a whole prefix, so that the
    set shares ``spec.common`` of them with a linked set for which the same
    holds. ``often`` are the frequent tokens, sorted, ``times`` their estimated counts.
    """
    n = len(tokens)
    rank = np.zeros(n, dtype=np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, tokens), len(often) - 1)
        rank = np.where(often[at] == tokens, times[at], 0)
    rare = int((rank == 0).sum())
    p, e = spec.prefix(n) + spec.common - 1, spec.extended(n)
    if n > TINY and rare >= p:
        return tokens[rank == 0][:p], tokens[:0], True
    frequent = tokens[rank > 0]
    frequent = frequent[np.lexsort((frequent, rank[rank > 0]))][: n if n <= TINY else max(0, e - rare)]
    return tokens if n <= TINY else tokens[rank == 0], _mix(_mix(frequent[:-1]) * np.uint64(0x9E3779B97F4A7C15) + frequent[1:]), n <= TINY


def _index(spec: Spec, classes):
    """(combined, sig, salt, node, n, whole) of the sets of a task; equal sets once per part."""

    def run(batches):
        import pyarrow as pa

        often, times, clashes = classes.value
        seen: set[int] = set()
        for batch in batches:
            parts = []
            for text in _texts(batch):
                s = token_set(text, spec.words)
                if not len(s) or (node := node_of(s, clashes)[0]) in seen:
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(node)
                single, pairs, whole = signatures(s, spec, often, times)
                parts += [(0, single, node, len(s), whole)] * bool(len(single)) + [(1, pairs, node, len(s), whole)] * bool(len(pairs))
            if parts:
                sizes = [len(p[1]) for p in parts]
                column = lambda k, kind: pa.array(np.repeat(np.array([p[k] for p in parts], dtype=kind), sizes))
                nodes = np.repeat(np.array([p[2] for p in parts], dtype=np.int64), sizes)
                combined = np.repeat(np.array([p[0] for p in parts], dtype=np.int32), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(combined), pa.array(np.concatenate([p[1] for p in parts]).view(np.int64)), pa.array((np.where(combined == 1, nodes % SALT, 0)).astype(np.int32)), pa.array(nodes), column(3, np.int32), column(4, np.int32)], names=["combined", "sig", "salt", "node", "n", "whole"])

    return run


def _groups(spec: Spec):
    """Sorted index entries to (kind, a, na, b, nb): 0 a candidate pair, 1 an edge of a family, 2 (signature, one member of its part), 3 a pair of sets with whole prefixes."""

    def run(batches):
        import pyarrow as pa

        names = ["kind", "a", "na", "b", "nb"]

        def out(kind, a, na, b, nb):
            return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(np.asarray(kind, dtype=np.int32), len(a))), pa.array(a), pa.array(na), pa.array(b), pa.array(nb)], names=names)

        def pairs(node, n, whole, start, size):
            for m in np.unique(size[(size > 1) & (size <= PAIR_GROUP)]):
                rows = start[size == m][:, None] + np.arange(m)
                i, j = np.triu_indices(m, 1)
                for part in np.array_split(rows, max(1, len(rows) * len(i) // 500_000 + 1)):
                    x, y = part[:, i].ravel(), part[:, j].ravel()
                    fits = (spec.den * np.minimum(n[x], n[y]) >= spec.num * np.maximum(n[x], n[y])) & (node[x] != node[y])
                    x, y = x[fits], y[fits]
                    swap = node[x] > node[y]
                    x, y = np.where(swap, y, x), np.where(swap, x, y)
                    yield out(np.where(whole[x] & whole[y] == 1, 3, 0), node[x], n[x], node[y], n[y])

        carry = None  # the rows of a group that may go on; of one that is known to be large, its first row
        large = False
        for batch in _ended(batches):
            cols = [np.zeros(0, dtype=t) for t in (np.int32, np.int64, np.int32, np.int64, np.int32, np.int32)] if batch is None else [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            fresh = 0 if carry is None else len(carry[0])
            if carry is not None:
                cols = [np.concatenate((c, x)) for c, x in zip(carry, cols)]
            if not len(cols[0]):
                continue
            # copies in several tasks give equal entries
            again = np.zeros(len(cols[0]), dtype=bool)
            again[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in cols[:4]])
            fresh -= int(again[:fresh].sum())
            cols = [c[~again] for c in cols]
            combined, sig, salt, node, n, entire = cols
            new = np.ones(len(sig), dtype=bool)
            new[1:] = (sig[1:] != sig[:-1]) | (combined[1:] != combined[:-1]) | (salt[1:] != salt[:-1])
            start = np.flatnonzero(new)
            size = np.diff(np.concatenate((start, [len(sig)])))
            group = np.cumsum(new) - 1
            first = start[group]
            star = combined == 1
            big = size > PAIR_GROUP
            if large:
                big[0] = True
            open_last = batch is not None
            # rows of families: all but the first of their group
            mask = (star | big[group]) & (np.arange(len(sig)) != first) & (node != node[first])
            if fresh and (large or combined[0] == 1):
                mask[:fresh] = False  # told before
            held = len(start) - 1 if open_last else len(start)
            if open_last and not (big[-1] or combined[-1] == 1):
                mask[start[-1] :] = False
            yield out(1, node[first[mask]], n[first[mask]], node[mask], n[mask])
            whole = np.arange(len(start)) < held
            plain = whole & (combined[start] == 0) & ~big
            yield from pairs(node, n, entire, start[plain], size[plain])
            tell = whole & (combined[start] == 1)
            yield out(2, sig[start[tell]], n[start[tell]], node[start[tell]], n[start[tell]])
            if open_last:
                s = start[-1]
                large = bool(big[-1])
                carry = [c[s : s + 1] if large or combined[s] == 1 else c[s:] for c in cols]
            else:
                carry = None

    return run


def _ended(batches):
    """The batches that have rows, then None."""
    for batch in batches:
        if batch.num_rows:
            yield batch
    yield None


def _verify(spec: Spec, clashes: frozenset):
    """Rows (unit, role, node, text), sorted by unit and role, to edges (a, b): the row of role 0 is compared with all others, one at a time."""

    def run(batches):
        import pyarrow as pa

        unit, center = None, None
        for batch in batches:
            edges = []
            keys = [batch.column(k).to_pylist() for k in range(3)]
            texts = batch.column(3).cast(pa.large_binary())
            for u, role, node, text in zip(*keys, texts):
                if unit != u:
                    unit, center = u, None
                s = token_set(text.as_py(), spec.words)
                if not len(s) or node_of(s, clashes)[0] != node:
                    continue  # another text of a repeated doc_id
                if role == 0:
                    center = s
                elif center is not None:
                    shared = len(np.intersect1d(center, s, assume_unique=True))
                    if spec.linked(shared, len(center), len(s)):
                        edges.append((u, node))
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])

    return run


def _sets(spec: Spec, clashes: frozenset):
    """Rows (unit, part, drawn, node, text) to the same with set size and tokens instead of the text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep, sets = [], []
            for k, (node, text) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).cast(pa.large_binary()))):
                s = token_set(text.as_py(), spec.words)
                if len(s) and node_of(s, clashes)[0] == node:  # else another text of a repeated doc_id
                    keep.append(k)
                    sets.append(s.view(np.int64))
            rows = batch.take(pa.array(keep, pa.int64()))
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in range(4)], pa.array([len(s) for s in sets], pa.int64()), tokens], names=["unit", "part", "drawn", "node", "n", "tokens"])

    return run


def frequent_class(profile: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequent tokens, sorted, and their estimated counts: CLASS_SIZE at most."""
    top = profile.filter("kind = 1").groupBy(F.col("id").alias("token")).agg(F.sum("n").alias("times")).filter(F.col("times") >= FREQUENT).orderBy(F.desc("times"), "token").limit(CLASS_SIZE)
    rows = top.toArrow()
    tokens, times = rows.column("token").to_numpy().view(np.uint64), rows.column("times").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], times[order]


def candidates(slim: DataFrame, classes, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b) and edges (a, b) of families, from the index."""
    entries = slim.mapInArrow(_index(spec, classes), "combined int, sig long, salt int, node long, n int, whole int")
    grouped = entries.repartition("combined", "sig", "salt").sortWithinPartitions("combined", "sig", "salt", "node").mapInArrow(_groups(spec), "kind int, a long, na int, b long, nb int")
    met = grouped.groupBy("kind", "a", "na", "b", "nb").agg(F.count("*").alias("times"))
    found = staged(met.filter((F.col("kind") < 3) | (F.col("times") >= spec.common)), "join-found")
    parts = found.filter("kind = 2").select(F.col("a").alias("sig"), "b")
    head = parts.groupBy("sig").agg(F.min("b").alias("h"))
    across = parts.join(head, "sig").filter("b <> h").select(F.col("h").alias("a"), "b")
    stars = found.filter("kind = 1").select("a", "b").union(across).distinct()
    return found.filter("kind IN (0, 3)").select("a", "b"), stars


def _with_unit(members: DataFrame, units: DataFrame) -> DataFrame:
    """``members`` with the columns of their unit's row, of which there are SALT: no task has to see all members of a large unit."""
    salts = F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))
    salted = members.withColumn("__salt", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(SALT).cast("long")))
    return salted.join(units.withColumn("__salt", F.explode(salts)), ["unit", "__salt"]).drop("__salt")


def _dealt(members: DataFrame) -> DataFrame:
    """``members`` (unit, node, ...) with ``part``, which the unit's base is sent to, and ``drawn``, whether the base is taken from it."""
    sizes = members.groupBy("unit").agg(F.count("*").alias("m"))
    share = lambda salt, of: F.pmod(F.xxhash64("node", "unit", F.lit(salt)), F.ceil(F.col("m") / of))
    return _with_unit(members, sizes).withColumn("part", share(1, PART).cast("int")).withColumn("drawn", share(2, DRAWN) == 0).drop("m")


def _centred(level: DataFrame, spec: Spec) -> DataFrame:
    """``tokens`` become what each set and its unit's base don't share; ``f`` goes along."""
    drawn = level.filter("drawn")
    counts = drawn.select("unit", F.explode("tokens").alias("t")).groupBy("unit", "t").agg(F.count("*").alias("c"))
    marked = counts.join(drawn.groupBy("unit").agg(F.count("*").alias("m")), "unit").filter("2 * c > m")
    base = marked.groupBy("unit").agg(F.collect_list("t").alias("base"))
    spread = level.select("unit", "part").distinct().join(base, "unit", "left").select("unit", "part", F.coalesce("base", F.array().cast("array<bigint>")).alias("base"))
    differ = F.concat(F.array_except("tokens", "base"), F.array_except("base", "tokens"))
    rows = level.join(spread, ["unit", "part"]).select("unit", "node", "n", "f", "sought", F.size("tokens").alias("had"), differ.alias("tokens"))
    return rows.withColumn("f", F.col("f") - (spec.den + spec.num) * (F.col("had") - F.size("tokens"))).drop("had")


def family_links(level: DataFrame, spec: Spec) -> DataFrame:
    """Edges (a, b) that join whatever links join within each unit of ``level`` (unit, part, drawn, node, n, tokens).

    In every round x and y are linked if f(x) + f(y) is at most 2 (den + num)
    times the tokens that they share; for whole sets f is 2 num |x|. A pair of
    which neither is ``sought`` has been joined before.
    """
    level = level.withColumn("f", 2 * spec.num * F.col("n")).withColumn("sought", F.lit(True))
    twice = 2 * (spec.den + spec.num)
    edges = []
    for _ in range(ROUNDS):
        centred = staged(_centred(level, spec), "join-centred")
        heads = centred.groupBy("unit").agg(F.min(F.struct("f", "node")).alias("h"), F.max("f").alias("most")).select("unit", F.col("h.f").alias("least"), F.col("h.node").alias("head"), "most")
        near = _with_unit(centred.select("unit", "node", "f"), heads).filter("f + least <= 0 AND node <> head")
        edges.append(near.select(F.col("head").alias("a"), F.col("node").alias("b")))
        # units with far members, which the head is not linked to for sure
        open_ = _with_unit(centred, heads.filter("most + least > 0")).withColumn("far", F.col("f") + F.col("least") > 0)
        held = open_.select("unit", "node", "n", "f", "far", "sought", F.explode("tokens").alias("t"))
        shared = held.groupBy("unit", "t").agg(F.count("*").alias("c")).filter("c > 1")
        listed = F.array_sort(F.collect_list(F.struct("c", "t")))
        rest = held.join(shared, ["unit", "t"]).groupBy("unit", "node").agg(*[F.first(c).alias(c) for c in ("n", "f", "far", "sought")], listed.alias("x"))
        rest = staged(rest.select("unit", "node", "n", "f", "far", "sought", F.col("x.t").alias("tokens"), F.size("x").alias("size")), "join-shared")
        # the least f by number of tokens, of all members and of far ones: at most as many entries as a set has sizes
        sizes = rest.groupBy("unit", "size").agg(F.min("f").alias("f"), F.min(F.when(F.col("far"), F.col("f"))).alias("far"))
        bounds = sizes.groupBy("unit").agg(F.collect_list(F.struct("size", "f", "far")).alias("others"))
        needs = lambda o: F.when(F.col("far"), o["f"]).otherwise(o["far"]) + F.col("f")
        able = F.filter("others", lambda o: needs(o) <= twice * F.least(o["size"], F.col("size")))
        least = F.array_min(F.transform(able, lambda o: F.ceil(needs(o) / twice)))
        prefix = F.slice("tokens", F.lit(1), (F.col("size") - F.greatest(F.lit(1), F.col("must")) + 1).cast("int"))
        asked = _with_unit(rest, bounds).withColumn("must", least).filter("must IS NOT NULL")
        entries = asked.select("unit", "node", "n", "f", "far", "sought", "size", F.posexplode(prefix).alias("pos", "t")).withColumn("rest", F.col("size") - 1 - F.col("pos"))
        mark = lambda salt: F.sum(F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(1 << 31)))
        groups = entries.groupBy("unit", "t").agg(F.count("*").alias("c"), F.max("far").alias("any_far"), F.max("sought").alias("any_sought"), F.min(F.struct("node", "pos")).alias("p"), mark(1).alias("s"), mark(2).alias("z")).filter("c > 1 AND any_far AND any_sought")
        # of tokens that the same members have, the first is the first common one: the order is the same for all
        groups = groups.groupBy("unit", "c", "s", "z").agg(F.min_by("t", F.col("p.pos")).alias("t")).select("unit", "t", "c")
        found = staged(entries.join(groups, ["unit", "t"]), "join-entries")
        few = found.filter(F.col("c") <= PAIR_GROUP).groupBy("unit", "t").agg(F.collect_list(F.struct("node", "n", "f", "far", "sought", "rest")).alias("g"))
        # a linked pair passes at the first token that both have: no more can follow than are left of the shorter rest
        room = lambda x, y: twice * (1 + F.least(x["rest"], y["rest"])) >= x["f"] + y["f"]
        fits = lambda x, y: (x["node"] < y["node"]) & (x["far"] | y["far"]) & (x["sought"] | y["sought"]) & room(x, y) & (spec.den * F.least(x["n"], y["n"]) >= spec.num * F.greatest(x["n"], y["n"]))
        pairs = F.flatten(F.transform("g", lambda x: F.transform(F.filter("g", lambda y: fits(x, y)), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
        pairs = few.select("unit", F.inline(pairs)).distinct()
        side = lambda name: rest.select("unit", F.col("node").alias(name), F.col("f").alias(f"f_{name}"), F.col("tokens").alias(f"t_{name}"))
        both = pairs.join(side("a"), ["unit", "a"]).join(side("b"), ["unit", "b"])
        edges.append(both.filter(F.col("f_a") + F.col("f_b") <= twice * F.size(F.array_intersect("t_a", "t_b"))).select("a", "b"))
        many = found.filter(F.col("c") > PAIR_GROUP).select(F.xxhash64("unit", "t").alias("unit"), F.col("unit").alias("parent"), "node", "pos", F.col("far").alias("sought"))
        if many.isEmpty():
            return reduce(DataFrame.union, edges)
        sets = rest.select(F.col("unit").alias("parent"), "node", "n", "f", "tokens")
        behind = F.slice("tokens", F.col("pos") + 2, F.size("tokens"))
        level = _dealt(many).join(sets, ["parent", "node"]).select("unit", "part", "drawn", "node", "n", (F.col("f") - twice // 2).alias("f"), "sought", behind.alias("tokens"))
        level = staged(level, "join-sets")
    raise RuntimeError(f"families did not come apart in {ROUNDS} rounds")


def link(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text); other columns don't matter.

    Every row has its own in the result. A null id has a null component and
    links nothing; a null, empty or wordless text has an empty set and is alone.
    Copies are linked, and rows that repeat an id name the same component if
    their sets are equal. A component is called by its smallest id, so there are no ties. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    slim = small_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")))
    profile = staged(slim.mapInArrow(_profile(spec), "kind int, id long, n long, node long, check long"), "join-profile")
    rows = profile.filter("kind = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "node", "check")
    halves = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("check").alias("x"), F.max("check").alias("y"))
    # as good as always none; by chance a few among more than 10^10 sets
    clashes = frozenset(r["node"] for r in halves.filter("x <> y").select("node").collect())
    if clashes:
        rows = rows.withColumn("node", F.when(F.col("node").isin(*clashes), F.col("check")).otherwise(F.col("node")))
    rows = rows.drop("check")
    names = rows.filter("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("name"))
    classes = spark.sparkContext.broadcast((*frequent_class(profile), clashes))
    known = slim.filter("doc_id IS NOT NULL")
    pairs, stars = candidates(known, classes, spec)
    units = pairs.select(F.col("a").alias("unit"), F.lit(1).alias("role"), F.col("b").alias("node")).union(pairs.select(F.col("a").alias("unit"), F.lit(0), F.col("a")).distinct())
    with_text = lambda wanted: wanted.join(names, "node").withColumnRenamed("name", "doc_id").join(known, "doc_id")
    compared = with_text(units).select("unit", "role", "node", "text").repartition("unit").sortWithinPartitions("unit", "role", "node").mapInArrow(_verify(spec, clashes), "a long, b long")
    members = staged(_dealt(connected_components(stars).withColumnRenamed("component", "unit")), "join-family")
    sets = with_text(members).select("unit", "part", "drawn", "node", "text").mapInArrow(_sets(spec, clashes), "unit long, part int, drawn boolean, node long, n long, tokens array<long>")
    edges = compared.union(family_links(staged(sets, "join-sets"), spec))
    groups = connected_components(edges)
    named = names.join(groups, "node", "left").select("node", "name", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("name").alias("least"))
    final = named.join(least, "component").select("node", "least")
    return rows.join(final, "node", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, spec: Spec = Spec(5, 80, 100)) -> DataFrame:
    """The documents of ``docs`` that are the smallest of their component, with all columns.

    Rows without id stay. Of repeated ids, all rows of the kept id stay if none of them is linked to a smaller one.
    """
    gone = link(docs, spec).filter("component_id < doc_id").select(F.col("doc_id").alias("__qm_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__qm_id"], "left_anti")
