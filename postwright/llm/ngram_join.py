"""N-gram Jaccard join with a prefix tree (operator 2).

Documents of equal shingle sets form a class, and one class member stands for
all. Then, exactly and without a comparison of all pairs:

1. *Sieve.* With any one global order of shingles, two sets that link share
   ``k`` of their first ``n - ceil(t n) + k`` ones. In the order of the hash
   values, sets that don't meet ``k`` others there are dropped at once.
2. *Order.* For what is left, shingles are ordered by document frequency and
   hash: a shingle's *place* is one number that holds both, and from here on
   stands for it. Shingles of one set alone can't match: a set keeps their
   number and the places of the others. They come first in the order, so a set
   whose prefix (its first ``n - ceil(t n) + 1`` shingles) has no other is done.
3. *Trees of leaders.* Each set goes to one leader: the set with the fewest
   shingles of its own among those that share a prefix shingle with it, the one
   it shares most with. A leader's sets are dealt in blocks, the leader in every
   block, and a block is joined by its prefix tree. This joins a large group of
   near copies at the cost of a row a member.
4. *Trees of shingles.* Sets that are still apart meet under each shingle of
   their prefixes, again in blocks that a prefix tree joins. Shingles that only
   sets already joined have are left out, and of shingles that the same sets
   have one stays. Where one component has most sets of a shingle, its sets are
   dealt once, and only the others visit all its blocks.

A tree holds the ordered sets, the commonest shingles first, so that sets with
a beginning in common share its nodes. A probe walks it with the overlap so far; a
subtree is pruned when the shingles that remain below it or to the probe can't
reach the required overlap, and when all its sets are joined with the probe
already. Overlaps are those of the whole sets, so that a pair that comes out is
a link; links within a task join sets at once, and a task puts out fewer links
than it has sets. Links are then followed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postwright.llm.common import materialize, own_columns, shingle_set, table, unused
from postwright.llm.components import components

#: Sets that meet under one leader or shingle are dealt in blocks of so many.
BLOCK = 256
#: ``k`` of the sieve, in percent of a set: at 10 a set goes on if about half (t = 0.9) or a third
#: (t = 0.8) of its first shingles occur elsewhere, which costs fewest rows in all.
SIEVE_PERCENT = 10
#: Ids or keys that are broadcast: 16 MB; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Keys of more rows are hot: what belongs to them is broadcast and their rows stay where they are.
HOT_ROWS = 1_000
#: Hot shingles are looked for in one of so many documents: those found are counted exactly, others are
#: dealt by shuffle, so that the choice changes who does the work and not the result.
LOOK = 64


def _need(n: Column, num: int, den: int) -> Column:
    """Smallest overlap of a set of ``n`` with any set that it links to: ceil(t n)."""
    return F.floor((n * num + (den - 1)) / den).cast("int")


def shingle_classes(docs: DataFrame, n: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, set)``: the sorted distinct shingle hashes of every row."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), shingle_set(F.col(f"`{text}`"), n).alias("set"))


def jaccard_components(
    docs: DataFrame,
    n: int = 5,
    num: int = 8,
    den: int = 10,
    id_col: str = "doc_id",
    text: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """``(doc_id, n_shingles, class_id, component_id)`` for every row of ``docs``.

    Two sets link when den * |intersection| >= num * |union|. ``class_id`` is the
    smallest doc_id with the same set, ``component_id`` the smallest that links
    lead to: links within what is joined already aren't looked for, as a group
    of near copies has them by the square of its size. Shingles are 64-bit hashes.
    Null and blank texts have an empty set and link with nothing; rows of a null
    doc_id are classes by their text but never lead a class. Repeated rows give
    repeated results; of different texts under one id the one with the smallest
    set of hashes links with others. Extra columns don't matter; an empty table
    gives an empty table.
    """
    docs, id_col, text = own_columns(docs, {id_col: "doc_id", text: "text"}), "doc_id", "text"
    size = F.size("set")
    k = lambda m: F.greatest(F.lit(1), F.floor(m * SIEVE_PERCENT / 100).cast("int"))
    first = size - _need(size, num, den) + k(size)
    sieve = materialize(
        shingle_classes(docs, n, id_col, text).select(
            "doc_id",
            size.alias("n"),
            F.xxhash64("set").alias("d1"),
            F.hash("set").alias("d2"),
            F.slice("set", F.lit(1), F.greatest(first, F.lit(1))).alias("least"),
        )
    )
    digest = ["n", "d1", "d2"]
    heads = materialize(sieve.where("n > 0").groupBy(*digest).agg(F.min("doc_id").alias("class_id")))

    # 1. sieve: shingles that a second set has among its least
    leads = heads.select(F.col("class_id").alias("doc_id")).distinct()
    least = sieve.where("n > 0").join(_small(leads), "doc_id", "left_semi")
    met = _shared(least.select("doc_id", F.explode("least").alias("s"))).groupBy("doc_id").agg(F.count("*").alias("met"))
    smallest_partner = _need(F.col("n"), num, den)
    left = sieve.select(F.col("doc_id").alias("keep_id"), "n").join(met, F.col("keep_id") == met["doc_id"])
    left = materialize(left.where(F.col("met") >= k(smallest_partner)).select("keep_id").distinct())

    # 2. order by frequency among what is left
    kept = docs.join(_small(left), F.col(f"`{id_col}`") == F.col("keep_id"), "left_semi")
    sets = shingle_classes(kept, n, id_col, text)
    if not sieve.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 and doc_id is not null").isEmpty():
        sets = sets.where(size > 0).groupBy("doc_id").agg(F.min("set").alias("set"))
    sets = materialize(sets.withColumn("n", F.size("set")))
    each = _shared(sets.select("doc_id", F.explode("set").alias("s")))
    common = each.groupBy("doc_id").agg(F.sort_array(F.collect_list("place")).alias("common"))
    own = F.col("n") - F.size("common")
    depth = F.col("n") - _need(F.col("n"), num, den) + 1 - own
    wholes = sets.select("doc_id", "n").join(common, "doc_id").select("doc_id", "n", own.alias("own"), depth.alias("depth"), "common")
    wholes = materialize(wholes.where("depth > 0"))
    prefix = F.slice("common", F.lit(1), F.col("depth"))

    # 3. trees of leaders
    star_links = materialize(leader_links(wholes, prefix, num, den, block))
    labels = components(star_links)

    # 4. trees of shingles, for what isn't joined yet
    tree_links = materialize(shingle_links(wholes, prefix, labels, num, den, block))

    roots = components(star_links.union(tree_links))
    of_class = heads.join(roots.toDF("class_id", "component_id"), "class_id", "left")
    of_class = of_class.select(*[F.col(c).alias(f"__{c}") for c in digest], "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    on = F.lit(True)
    for c in digest:
        on = on & (sieve[c] == of_class[f"__{c}"])
    return (
        sieve.select("doc_id", *digest)
        .join(of_class, on, "left")
        .select(
            "doc_id",
            F.col("n").cast("long").alias("n_shingles"),
            F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce("component_id", "doc_id").alias("component_id"),
        )
    )


def leader_links(wholes: DataFrame, prefix: Column, num: int, den: int, block: int) -> DataFrame:
    """Links ``(a, b)`` that the trees of leaders find."""
    under = wholes.select("doc_id", "n", "own", F.explode(prefix).alias("s"))
    centres = under.groupBy("s").agg(F.min(F.struct(F.col("own") / F.col("n"), "doc_id")).alias("c"), F.count("*").alias("m")).where("m > 1")
    centres = materialize(centres.select("s", F.col("c.doc_id").alias("leader"), "m"))
    led = (
        _by_key(under.select("doc_id", "s"), centres, "s")
        .where("leader <> doc_id")
        .groupBy("doc_id", "leader")
        .agg(F.count("*").alias("times"))
        .groupBy("doc_id")
        .agg(F.max_by("leader", F.struct("times", "leader")).alias("leader"))
    )
    led = materialize(led)
    sizes = materialize(led.groupBy("leader").agg(F.count("*").alias("m")).withColumn("blocks", F.ceil(F.col("m") / block).cast("int")))
    members = _by_key(led, sizes, "leader").select("leader", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("j"), "doc_id")
    every = sizes.select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.col("leader").alias("doc_id"))
    dealt = members.union(every).select(F.col("leader").alias("s"), F.lit(0).alias("i"), "j", F.col("j").alias("mine"), "doc_id", F.col("doc_id").alias("label"))
    # a block is joined with itself
    return _joined(dealt.withColumn("i", F.col("j")), wholes, num, den)


def shingle_links(wholes: DataFrame, prefix: Column, labels: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """Links ``(a, b)`` between sets of different ``labels`` that share a shingle of their prefixes."""
    marked = wholes.join(labels.toDF("doc_id", "label"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    meet = materialize(marked.select("doc_id", "label", F.explode(prefix).alias("s")))
    who = lambda seed: F.bit_xor(F.xxhash64("doc_id", F.lit(seed)))
    by_label = meet.groupBy("s", "label").agg(F.count("*").alias("c"), who(0).alias("x"), who(1).alias("y"))
    open_ = by_label.groupBy("s").agg(
        F.sum("c").alias("m"), F.count("*").alias("labels"), F.max(F.struct("c", "label")).alias("most"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")
    )
    open_ = open_.where("labels > 1").groupBy("m", "x", "y").agg(F.min(F.struct("s", "most")).alias("one"))
    rest = F.col("m") - F.col("one.most.c")
    open_ = open_.select(
        "one.s",
        "m",
        F.col("one.most.label").alias("most"),
        F.when(F.col("m") <= block, 1).otherwise(F.ceil(rest / block)).cast("int").alias("rests"),
        F.when(F.col("m") <= block, 0).otherwise(F.ceil(F.col("one.most.c") / block)).cast("int").alias("mosts"),
    )
    open_ = materialize(open_)
    met = _by_key(meet, open_, "s")
    in_most = (F.col("label") == F.col("most")) & (F.col("mosts") > 0)
    deal = lambda blocks: F.pmod(F.xxhash64("doc_id"), F.greatest(blocks, F.lit(1))).cast("int")
    met = met.withColumn("mine", F.when(in_most, F.col("rests") + deal(F.col("mosts"))).otherwise(deal(F.col("rests"))))
    partners = F.when(in_most, F.col("rests")).otherwise(F.col("rests") + F.col("mosts")) - 1
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0), partners))).select(
        "s", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "doc_id", "label"
    )
    return _joined(dealt, wholes, num, den)


def _joined(dealt: DataFrame, wholes: DataFrame, num: int, den: int) -> DataFrame:
    """Links within the blocks ``(s, i, j)``: sets of block ``i`` against those of block ``j``."""
    dealt = materialize(dealt)
    ids = dealt.select("doc_id").distinct()
    sets = wholes.select("doc_id", "n", "common").join(_small(ids), "doc_id", "left_semi")
    return (
        dealt.join(sets, "doc_id")
        .repartition("s", "i", "j")
        .sortWithinPartitions("s", "i", "j", "doc_id")
        .select("s", "i", "j", "mine", "doc_id", "n", "label", "common")
        .mapInPandas(lambda it: _tree_join(it, num, den), "a bigint, b bigint")
        .distinct()
    )


def _small(ids: DataFrame) -> DataFrame:
    """For a join: broadcast up to BROADCAST_ROWS rows of ids, shuffled beyond."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def _by_key(rows: DataFrame, keyed: DataFrame, on: str) -> DataFrame:
    """``rows`` with the one row of ``keyed`` for their key; ``m`` of it is the key's number of rows.

    Hot keys are broadcast, which moves none of their rows. There are at most
    BROADCAST_ROWS of them, as each has more than that part of all rows.
    """
    total = keyed.agg(F.sum("m")).first()[0] or 0
    hot_rows = max(HOT_ROWS, total // BROADCAST_ROWS)
    hot = F.col("m") > hot_rows
    if keyed.where(hot).isEmpty():
        return rows.join(keyed, on)
    cold = rows.join(F.broadcast(keyed.where(hot).select(on)), on, "left_anti").join(keyed.where(~hot), on)
    return rows.join(F.broadcast(keyed.where(hot)), on).unionByName(cold)


def _shared(each: DataFrame) -> DataFrame:
    """``(doc_id, s, place)``: the rows whose shingle several sets have, with its place in the order.

    A place has the logarithm of the frequency (steps of half a percent) above
    the hash's upper 51 bits. Any order gives the same links. Rows are dealt by
    shingle once, and what counts them and what joins the counts read the same
    exchange; a shingle's rows are streamed, never held together. Rows of hot
    shingles aren't dealt at all: they are counted task by task.
    """
    looked = each.where(F.pmod(F.xxhash64("doc_id"), F.lit(LOOK)) == 0).groupBy("s").agg(F.count("*").alias("c"))
    looked = materialize(looked.where(F.col("c") * LOOK > HOT_ROWS))
    total = looked.agg(F.sum("c")).first()[0] or 0
    hot = F.broadcast(looked.where(F.col("c") > total // BROADCAST_ROWS).select("s"))
    step = F.least(F.floor(F.log2("df") * 128), F.lit(4095)).cast("long")
    place = F.shiftleft(step, 51).bitwiseOR(F.shiftrightunsigned("s", 13))

    def placed(rows: DataFrame) -> DataFrame:
        often = rows.groupBy("s").agg(F.count("*").alias("df"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        return often.where("lo < hi").select("s", place.alias("place"))

    dealt = each.select("doc_id", "s")
    if total == 0:
        dealt = dealt.repartition("s")
        return dealt.join(placed(dealt), "s")
    here = dealt.join(hot, "s")
    there = dealt.join(hot, "s", "left_anti").repartition("s")
    known = F.broadcast(materialize(placed(here)))  # a row a hot shingle
    return here.join(known, "s").unionByName(there.join(placed(there), "s"))


class _Node:
    """A node of the prefix tree: the places that lead to it from the node above, and bounds of what is below."""

    __slots__ = ("edge", "kids", "ends", "least_n", "most_left", "label")

    def __init__(self, edge: np.ndarray) -> None:
        self.edge = edge
        self.kids: dict[int, _Node] = {}
        self.ends: list[tuple] = []  # sets that end here
        self.least_n = 1 << 60
        self.most_left = 0  # places of the longest set below, from the first of this edge on
        self.label: int | None = -1  # of a set below while all below are joined, else None


class _Tree:
    """Sets as paths of a tree, and which of them are joined."""

    def __init__(self, num: int, den: int) -> None:
        self.root = _Node(np.empty(0, dtype=np.int64))
        self.num, self.den = num, den
        self.up: dict[int, int] = {}

    def find(self, label: int) -> int:
        top = label
        while (above := self.up.get(top, top)) != top:
            top = above
        while label != top:
            label, self.up[label] = self.up.get(label, label), top
        return top

    def insert(self, row: tuple) -> None:
        doc, n, label, places = row
        node, at = self.root, 0
        while True:
            edge = node.edge
            k = min(len(edge), len(places) - at)
            differ = np.flatnonzero(edge[:k] != places[at : at + k])
            k = int(differ[0]) if len(differ) else k
            if k < len(edge):  # the path forks within the edge
                below = _Node(edge[k:])
                below.kids, below.ends, below.least_n, below.label = node.kids, node.ends, node.least_n, node.label
                below.most_left = node.most_left - k
                node.edge, node.kids, node.ends = edge[:k], {int(edge[k]): below}, []
            node.least_n = min(node.least_n, n)
            node.most_left = max(node.most_left, len(places) - at)
            if node.label == -1:
                node.label = label
            elif node.label is not None and self.find(node.label) != self.find(label):
                node.label = None
            at += k
            if at == len(places):
                node.ends.append(row)
                return
            kid = node.kids.get(int(places[at]))
            if kid is None:
                kid = node.kids[int(places[at])] = _Node(places[at:])
            node = kid

    def probe(self, row: tuple) -> Iterator[tuple[int, int]]:
        """Links of ``row`` to sets of the tree that aren't joined with it; each joins them."""
        doc, n, label, places = row
        num, limit = self.num, self.num + self.den
        todo = [(self.root, 0, 0)]  # node, places of the probe passed, overlap
        while todo:
            node, at, both = todo.pop()
            mine = self.find(label)
            if node.label is not None and (node.label == -1 or self.find(node.label) == mine):
                continue
            # den * both >= num * (n + other - both) must be within reach
            if (both + min(len(places) - at, node.most_left)) * limit < num * (n + node.least_n):
                continue
            edge = node.edge
            if len(edge):
                end = int(np.searchsorted(places, edge[-1], side="right"))
                part = places[at:end]
                if len(part):
                    i = np.searchsorted(edge, part)
                    i[i == len(edge)] = 0
                    both += int(np.count_nonzero(edge[i] == part))
                at = end
            for other in node.ends:
                if both * limit >= num * (n + other[1]) and self.find(other[2]) != self.find(label):
                    yield other[0], doc
                    self.up[self.find(other[2])] = self.find(label)
            todo.extend((kid, at, both) for kid in node.kids.values())


def _tree_join(batches: Iterator[pd.DataFrame], num: int, den: int) -> Iterator[pd.DataFrame]:
    """Links within each run of equal (s, i, j) of a sorted partition; a run has 2 * BLOCK rows or so."""

    def joined(key: tuple, rows: list[tuple]) -> list[tuple[int, int]]:
        i, j = key[1:]
        tree = _Tree(num, den)
        out: list[tuple[int, int]] = []
        if i == j:
            for mine, row in rows:
                out.extend(tree.probe(row))
                tree.insert(row)
            return out
        for mine, row in rows:
            if mine == j:
                tree.insert(row)
        for mine, row in rows:
            if mine == i:
                out.extend(tree.probe(row))
        return out

    key, rows = None, []
    for pdf in batches:
        out: list[tuple[int, int]] = []
        for s, i, j, mine, doc, n, label, common in pdf.itertuples(index=False, name=None):
            if (s, i, j) != key:
                if rows:
                    out.extend(joined(key, rows))
                key, rows = (s, i, j), []
            rows.append((mine, (doc, n, label, -np.array(common, dtype=np.int64)[::-1])))  # the commonest first
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    if rows:
        yield pd.DataFrame(joined(key, rows), columns=["a", "b"], dtype="int64")


def keep_first(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id. Rows of a null id stay, extra columns of any name too."""
    (name,) = unused(docs, "other_id")
    found = jaccard_components(docs, n, num, den, id_col, text).where("component_id < doc_id").select(F.col("doc_id").alias(name))
    return docs.join(found.distinct(), F.col(f"`{id_col}`") == F.col(name), "left_anti")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "class_id")


OP2_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE w[i:i + 2] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), sets AS (SELECT doc_id, count(*) AS n, hash(list(g ORDER BY g)) AS h FROM s GROUP BY doc_id
), classes AS (SELECT n, h, min(doc_id) AS class_id FROM sets GROUP BY n, h
), member AS (SELECT doc_id, s.n, class_id FROM sets s JOIN classes c ON s.n = c.n AND s.h = c.h
), t AS (SELECT class_id AS doc_id, c.n, s.g FROM classes c JOIN s ON s.doc_id = c.class_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id AND a.n * 100 >= 90 * b.n AND b.n * 100 >= 90 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT class_id AS a, class_id AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
), roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(m.n, 0) AS BIGINT) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id,
  coalesce(m.class_id, d.doc_id) AS class_id
FROM documents d LEFT JOIN member m ON d.doc_id = m.doc_id LEFT JOIN roots r ON m.class_id = r.a
"""
