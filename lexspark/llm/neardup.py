"""Near-duplicate documents by a chosen-path set similarity join (Christiani and Pagh; Christiani, Pagh and Sivertsen).

Each document's set of word shingles is embedded as `positions` MinHash tokens. In every one of `trees`
independent trees a document descends from the root: at a node it chooses its minwise tokens under a hash of that
node (`branch` of them at the root and its children, one below), and each names a child. Similar sets choose alike. Documents that meet in a node are compared;
nodes that are too large branch further.

Documents of equal sets form one class, and classes are what the trees hold. What is sought are the components
of the link graph, so a pair whose classes are already connected needs no comparison:

1. In the first `STARS` trees every class is paired with the least class of its smallest node and of its largest
   one: so many pairs at most as classes, times four, however alike the members of a node are. Pairs whose MinHash values
   can't reach the threshold are left out, the others are confirmed, and components are formed.
2. Nodes of all trees that still hold several components are compared exhaustively across components, where they are: first
   by MinHash values, which leaves the classes that may have a partner, then by the full sets of these. What leaves a node are
   confirmed links alone, and no more of them than connect its components: a forest, so a node of n classes gives n - 1 rows at most.
3. Nodes of more than `limit` comparisons or `room` shingles branch again, by one token a level down to `depth`, only to connect
   early what is most alike, for each level loses pairs. The large nodes themselves are then compared across the components that are left,
   block by block where they are still large.

Links are confirmed on the words themselves, not on hashes of them (minhash.Sets). No link between components is lost that
the trees find at `start` levels, whatever a node's size. n classes that share a node without being linked cost n * n / 2
comparisons of MinHash values. Two sets of similarity 0.8 meet in one tree with probability 0.75, in six with 0.9997; two of 0.85
with 0.85 and 0.99999. Their MinHash values fall short by more than MARGIN with probability 0.0002 at 0.8 and less at 0.85.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, hash_runs, hash_words, map_arrow, mix, signed, small_batches, stage, unstage, unused
from .components import components
from .minhash import Permutations, Sets, reach, set_key

POSITIONS = 256
#: By so much may the share of equal MinHash values fall short of the threshold: four standard deviations at 0.85, 3.6 at 0.8.
MARGIN = 0.09
#: Trees whose nodes give the pairs of the first step; most components are found in them, and the rest by the second.
STARS = 2
_SECOND = 0x5851F42D4C957F2D


def _matrix(column: pa.Array) -> np.ndarray:
    """Signatures, rows x positions; all of a column are of one length."""
    if not len(column):
        return np.zeros((0, 1), np.uint16)
    at, data = column.buffers()[1:]
    offsets = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(np.uint16).reshape(len(column), -1)


def choose(tokens: np.ndarray, nodes: np.ndarray, branch: int) -> np.ndarray:
    """The children (rows x branch) that sets with these token hashes (rows x positions) choose at their nodes."""
    under = mix(tokens ^ nodes[:, None])
    best = np.partition(under, branch - 1, axis=1)[:, :branch]
    return mix(best + nodes[:, None])


def token_hashes(signatures: np.ndarray) -> np.ndarray:
    return mix(signatures.astype(np.uint64) | (np.arange(1, signatures.shape[1] + 1, dtype=np.uint64) << np.uint64(16))[None, :])


def classes_of(df: DataFrame, id: str, text: str, words: int, positions: int = POSITIONS, lower: bool = True, lead: int = 0) -> tuple[DataFrame, DataFrame]:
    """(base, classes): base has i, t, n (set size) and k (class) of each row; classes has k, n, signature s, the
    least id m, and the i and t of one member. Rows without an id or without words are in no class.

    A class are the rows of one set, known by two keys of 64 bits from unrelated hashes of the words. k is the first
    key; should two classes share it, the keys of all such are drawn anew from both. lower: A-Z count as a-z. lead: so many
    blank words stand before each text."""
    docs = df.select(F.col(id).alias("i"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("x"))
    permutations, blank = Permutations(positions), np.arange(1, lead + 1, dtype=np.uint64)

    def embed(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(batch.column(2), lower)
        second = hash_words(w.data, w.starts, w.ends, _SECOND)
        sizes, keys, signatures = np.zeros(len(w), np.int64), np.zeros((2, len(w)), np.uint64), np.empty((len(w), positions), np.uint16)
        for j in range(len(w)):
            n = w.count(j)
            k = min(words, n + lead)
            own, at = np.unique(hash_runs(np.concatenate([blank, w.of(j)]), k), return_index=True) if n else (w.of(j), [])
            sizes[j], signatures[j] = len(own), permutations.least(own)
            keys[0, j] = set_key(own, len(own) * words + k)
            keys[1, j] = set_key(hash_runs(np.concatenate([blank, second[w.first[j] : w.first[j + 1]]]), k)[at], len(own)) if n else 0
        ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * (2 * positions))
        binary = pa.Array.from_buffers(pa.binary(), len(w), [None, ends.buffers()[1], pa.py_buffer(signatures.tobytes())])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(signed(keys[0])), pa.array(signed(keys[1])), binary], names=["i", "t", "n", "k", "l", "s"])

    base = stage(map_arrow(docs, embed, "i long, t long, n long, k long, l long, s binary"), "sets")
    members = base.where("n > 0 and i is not null")
    twice = members.groupBy("k").agg(F.min("l").alias("lo"), F.max("l").alias("hi")).where("lo < hi")
    if not twice.isEmpty():
        anew = base.join(twice.select("k", F.lit(True).alias("anew")), "k", "left")
        base = stage(anew.withColumn("k", F.when(F.col("anew"), F.xxhash64("l", "k")).otherwise(F.col("k"))).drop("anew").select(*base.columns), "sets")
        members = base.where("n > 0 and i is not null")
    one = members.groupBy("k").agg(F.min(F.struct("i", "t", "n", "s")).alias("z"))
    classes = stage(one.select("k", "z.n", "z.s", F.col("z.i").alias("m"), "z.i", "z.t"), "classes")
    rows = stage(base.drop("s", "l"), "rows")
    unstage(base)
    return rows, classes


def _alike(least: float):
    """A column: may the signatures s1, s2 and sizes n1, n2 belong to sets of the wanted similarity?"""

    @F.arrow_udf("boolean")
    def alike(s1: pa.Array, s2: pa.Array) -> pa.Array:
        return pa.array((_matrix(s1) == _matrix(s2)).sum(axis=1) >= least)

    return alike


def _sizes_allow(percent: int) -> Column:
    return F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent


def by_node(function, columns: int):
    """An iterator function for mapInArrow over rows sorted by their first column: `function` gets the columns of whole
    nodes, as Arrow arrays, and gives a batch."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            g = np.asarray(table.column(0))
            other = np.flatnonzero(g != g[-1]) if len(g) else g
            last = int(other[-1]) + 1 if len(other) else 0
            rest = table.slice(last)
            if last:
                yield function(*(table.column(j).slice(0, last).combine_chunks() for j in range(columns)))
        if rest is not None and rest.num_rows:
            yield function(*(rest.column(j).combine_chunks() for j in range(columns)))

    return run


def edges_of(g: np.ndarray) -> list[tuple[int, int]]:
    at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
    return list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def outside(c: np.ndarray) -> np.ndarray:
    """The places that are not of the largest component."""
    values, counts = np.unique(c, return_counts=True)
    return np.flatnonzero(c != values[counts.argmax()])


class Join:
    """One similarity join; see the module's text. percent: link when 100 * intersection >= percent * union."""

    positions, margin, lower, lead = POSITIONS, MARGIN, True, 0

    def __init__(self, df: DataFrame, id: str, text: str, words: int, percent: int, trees: int = 6, branch: int = 2, start: int = 3, limit: int = 1 << 22, room: int = 1 << 21, depth: int = 8):
        self.words, self.percent, self.trees, self.branch, self.start, self.limit, self.room, self.depth = words, percent, trees, branch, start, limit, room, depth
        self.docs = df.select(F.col(id).alias("i"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("x"))
        self.least = self.positions * (percent / 100 - self.margin)
        self.base, self.classes = classes_of(df, id, text, words, self.positions, self.lower, self.lead)

    def nodes(self):
        """A function from signatures to the nodes of each (rows x nodes), `start` levels below the roots; nothing so near the root is
        small. A node's last three bits tell its tree."""
        trees, branch, start = self.trees, self.branch, self.start

        def run(signatures: np.ndarray) -> np.ndarray:
            tokens, nodes = token_hashes(signatures), []
            for tree in range(trees):
                at = mix(np.full((len(tokens), 1), tree + 1, np.uint64))
                for level in range(start):
                    at = np.concatenate([choose(tokens, at[:, c], branch if level < 2 else 1) for c in range(at.shape[1])], axis=1)
                nodes.append(at >> np.uint64(3) << np.uint64(3) | np.uint64(tree % 8))
            return np.concatenate(nodes, axis=1)

        return run

    def descend(self) -> DataFrame:
        """(g, k, n): each class, with its size, in its nodes."""
        nodes_of = self.nodes()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes = nodes_of(_matrix(batch.column(2)))
            each = [pa.array(np.repeat(np.asarray(batch.column(j)), nodes.shape[1])) for j in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(signed(nodes.ravel())), *each], names=["g", "k", "n"])

        return map_arrow(self.classes.select("k", "n", "s"), run, "g long, k long, n long")

    def texts_of(self, keys: DataFrame) -> DataFrame:
        """(k, x): the text of one member of each of the distinct classes."""
        wanted = self.classes.select("k", "i", "t").join(keys, "k")
        return stage(self.docs.join(wanted, ["i", "t"]).dropDuplicates(["i", "t"]).select("k", "x"), "texts")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs (a, b) of classes whose full sets are similar enough."""
        percent, words, cls, lower, lead = self.percent, self.words, self.classes, self.lower, self.lead
        side = lambda n: cls.select(F.col("k").alias("ab"[n - 1]), F.col("n").alias(f"n{n}"), F.col("s").alias(f"s{n}"))
        likely = pairs.join(side(1), "a").join(side(2), "b").where(_sizes_allow(percent))
        likely = stage(likely.where(_alike(self.least)(F.col("s1"), F.col("s2"))).select("a", "b"), "likely")
        texts = self.texts_of(likely.select(F.col("a").alias("k")).union(likely.select(F.col("b").alias("k"))).distinct())
        both = likely.join(texts.select(F.col("k").alias("a"), F.col("x").alias("x1")), "a").join(texts.select(F.col("k").alias("b"), F.col("x").alias("x2")), "b")

        def check(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = Sets(Words(pa.concat_arrays([batch.column(2), batch.column(3)]), lower), words, lead)
            one = np.arange(batch.num_rows)
            two = one + len(one)
            return batch.select([0, 1]).filter(pa.array(reach(sets.common(one, two), sets.size[one], sets.size[two], percent)))

        out = stage(map_arrow(both.select("a", "b", "x1", "x2"), check, "a long, b long"), "links")
        unstage(likely, texts)
        return out

    def inside(self, members: DataFrame) -> DataFrame:
        """Links (a, b) that connect the components (c) inside the nodes (g) as far as any links do. Where f is 0 or 1,
        rows meet those of the other value only."""
        least, percent, words, lower, lead = self.least, self.percent, self.words, self.lower, self.lead

        def may(g, k, c, f, n, s) -> pa.RecordBatch:
            """The rows that may have a partner in another component, by MinHash values."""
            g, k, c, f, n = (np.asarray(x) for x in (g, k, c, f, n))
            s, use = _matrix(s), np.zeros(len(g), bool)
            for lo, hi in edges_of(g):
                for x in (lo + outside(c[lo:hi])).tolist():
                    y = lo + np.flatnonzero((c[lo:hi] != c[x]) & ((f[lo:hi] != f[x]) | (f[x] < 0)) & (np.minimum(n[lo:hi], n[x]) * 100 >= np.maximum(n[lo:hi], n[x]) * percent))
                    y = y[(s[y] == s[x]).sum(axis=1) >= least]
                    if len(y):
                        use[x] = use[y] = True
            return pa.RecordBatch.from_arrays([pa.array(v[use]) for v in (g, k, c, f)], names=["g", "k", "c", "f"])

        def link(g, k, c, f, x) -> pa.RecordBatch:
            """A forest of links, confirmed on the full sets."""
            g, k, c, f = (np.array(v) for v in (g, k, c, f))
            sets, a, b = Sets(Words(x, lower), words, lead), [], []
            mark = np.zeros(sets.kinds, bool)
            for lo, hi in edges_of(g):
                first, codes, size = sets.first[lo:hi] - sets.first[lo], sets.codes[sets.first[lo] : sets.first[hi]], sets.size[lo:hi]
                for j in outside(c[lo:hi]).tolist():
                    mark[sets.of(lo + j)] = True
                    common = np.add.reduceat(mark[codes], first, dtype=np.int64)
                    mark[sets.of(lo + j)] = False
                    free = (f[lo:hi] != f[lo + j]) | (f[lo + j] < 0)
                    for y in (lo + np.flatnonzero(reach(common, size, size[j], percent) & free)).tolist():
                        if c[y] != c[lo + j]:
                            a.append(k[lo + j])
                            b.append(k[y])
                            c[lo:hi][c[lo:hi] == c[y]] = c[lo + j]
            return pa.RecordBatch.from_arrays([pa.array(np.array(v, np.int64)) for v in (a, b)], names=["a", "b"])

        small_batches(members.sparkSession)
        rows = members.join(self.classes.select("k", "s"), "k").select("g", "k", "c", "f", "n", "s")
        near = stage(rows.repartition("g").sortWithinPartitions("g").mapInArrow(by_node(may, 6), "g long, k long, c long, f int"), "near")
        texts = self.texts_of(near.select("k").distinct())
        rows = near.join(texts, "k").select("g", "k", "c", "f", "x")
        out = stage(rows.repartition("g").sortWithinPartitions("g").mapInArrow(by_node(link, 5), "a long, b long").distinct(), "links")
        unstage(near, texts)
        return out

    def deeper(self, members: DataFrame) -> DataFrame:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes = choose(token_hashes(_matrix(batch.column(4))), np.asarray(batch.column(0)).view(np.uint64), 1)
            return pa.RecordBatch.from_arrays([pa.array(signed(nodes.ravel())), *(batch.column(j) for j in (1, 2, 3))], names=["g", "k", "n", "c"])

        return map_arrow(members.join(self.classes.select("k", "s"), "k").select("g", "k", "n", "c", "s"), run, "g long, k long, n long, c long")

    def mixed(self, members: DataFrame) -> DataFrame:
        """Of members (g, k, n, c) those in nodes with several components, with what the node holds: z classes, r shingles,
        q comparisons, and le, lr and lc of its largest component."""
        each = members.groupBy("g", "c").agg(F.count("*").alias("e"), F.sum("n").alias("r"))
        nodes = each.groupBy("g").agg(F.sum("e").alias("z"), F.sum("r").alias("r"), F.sum(F.col("e") * F.col("e")).alias("w"), F.count("*").alias("m"), F.max(F.struct("e", "r", "c")).alias("l")).where("m > 1")
        nodes = nodes.select("g", "z", "r", ((F.col("z") * F.col("z") - F.col("w")) / 2).alias("q"), F.col("l.e").alias("le"), F.col("l.r").alias("lr"), F.col("l.c").alias("lc"))
        return stage(members.join(nodes, "g"), "mixed")

    def run(self) -> DataFrame:
        """One row for each row of the input: i, t, n, c; c is the least id of its component, its own id without links."""
        nodes = self.descend()
        leads = nodes.groupBy("g").agg(F.min("k").alias("a"), F.max("k").alias("last"), F.count("*").alias("z")).where("a < last").select("g", "a", "z")
        multi = stage(nodes.join(leads, "g"), "nodes")
        stars = multi.where(F.pmod("g", F.lit(8)) < STARS).groupBy("k", F.pmod("g", F.lit(8)).alias("tree")).agg(F.min(F.struct("z", "a")).alias("x"), F.max(F.struct("z", "a")).alias("y"))
        stars = stars.select(F.col("k").alias("b"), F.explode(F.array("x.a", "y.a")).alias("a")).where("a <> b")
        links = self.confirm(stars.select("a", "b").distinct())
        found = components(links)
        members = self.mixed(self.named(multi, found))
        unstage(multi)
        small = (F.col("q") <= self.limit) & (F.col("r") <= self.room)
        more = self.inside(whole(members.where(small)))
        large = members.where(~small)
        if not large.isEmpty():
            nodes, level = large, self.start
            while level < self.depth and not nodes.isEmpty():
                level += 1
                below = self.mixed(self.deeper(nodes))
                more, nodes = more.union(self.inside(whole(below.where(small)))), below.where(~small)
            found = components(links.union(more))
            again = self.mixed(self.named(large, found))
            more = more.union(self.inside(whole(again.where(small)))).union(self.inside(self.blocks(again.where(~small))))
        if not more.isEmpty():
            found = components(links.union(more))
        unstage(members)
        named = self.classes.select("k", "m").join(found.withColumnRenamed("v", "k").withColumnRenamed("m", "c"), "k", "left").withColumn("c", F.coalesce("c", "k"))
        least = named.groupBy("c").agg(F.min("m").alias("o"))
        owner = named.join(least, "c").select("k", "o")
        return self.base.join(owner, "k", "left").select("i", "t", "n", F.when(F.col("n") > 0, F.coalesce("o", "i")).otherwise(F.col("i")).alias("c"))

    def named(self, nodes: DataFrame, found: DataFrame) -> DataFrame:
        return nodes.select("g", "k", "n").join(found.withColumnRenamed("v", "k"), "k", "left").select("g", "k", "n", F.coalesce("m", "k").alias("c"))

    def blocks(self, large: DataFrame) -> DataFrame:
        """Large nodes as pairs of blocks of classes, such that each two classes of different components meet once. Blocks
        of a node's largest component meet those of the rest only; what goes into the same block is free."""
        size, room = max(1, 2 * int(self.limit**0.5)), max(1, self.room // 2)
        count = lambda n, r: F.greatest(F.ceil(n / F.lit(size)), F.ceil(r / F.lit(room))).cast("int")
        dealt = large.withColumns({"big": F.col("c") == F.col("lc"), "rest": count(F.col("z") - F.col("le"), F.col("r") - F.col("lr")), "most": count(F.col("le"), F.col("lr"))})
        dealt = dealt.withColumn("x", F.pmod(F.xxhash64("k", F.lit(11)), F.when(F.col("big"), F.col("most")).otherwise(F.col("rest"))).cast("int"))
        dealt = dealt.withColumn("x", F.when(F.col("big"), F.col("x") + F.col("rest")).otherwise(F.col("x")))
        partners = F.when(F.col("big"), F.sequence(F.lit(0), F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("rest") + F.col("most") - 1))
        dealt = dealt.withColumn("y", F.explode(partners))
        side = F.when(F.col("x") == F.col("y"), F.lit(-1)).otherwise((F.col("x") > F.col("y")).cast("int"))
        return dealt.select(F.xxhash64("g", F.least("x", "y"), F.greatest("x", "y")).alias("g"), "k", "c", "n", side.alias("f"))


def whole(members: DataFrame) -> DataFrame:
    return members.select("g", "k", "c", "n", F.lit(-1).alias("f"))


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, **options) -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id, kept.

    Null and empty texts have empty sets and link with nothing; so do rows without an id (component_id null, kept).
    Rows repeated under one id share a result. Empty tables give no rows.
    """
    out = Join(df, id, text, words, percent, **options).run()
    return out.select(F.col("i").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.coalesce(F.col("i") == F.col("c"), F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, **options) -> DataFrame:
    """df with the document of the least id of each component; all columns stay. Rows without an id stay."""
    i, t = unused(df, "__i", "__t")
    gone = Join(df, id, text, words, percent, **options).run().where("i <> c").select(F.col("i").alias(i), F.col("t").alias(t)).distinct()
    return df.join(gone, (F.col(id) == F.col(i)) & (F.xxhash64(F.col(text)) == F.col(t)), "left_anti")
