"""Conversation prefix trie by the Euler-tour technique (operator 12).

Every prefix of a conversation is a node. Its name is a pair of sums of hashes of (depth, turn), so a prefix needs only running sums, and
its parent's name is the same sums without the last turn. Subtree totals come from the trie's Euler tour: each node has an arc on
the way in and one on the way out, the tour is a linked list of arcs, the list is ranked with weights in rounds that each join it
with itself, and a node's total is the difference of the prefix sums at its two arcs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartspan.llm.common import text_or_empty, written
from chartspan.operators.ordered import in_order

#: Conversations of so many consecutive ids start with the turns of the first of them, in the query's contract; so many different lengths.
FAMILY, SHARED = 100, 6
#: A list of at most so many arcs is ranked in one task.
LAST = 1 << 16
_NAME, _SUMS = "decimal(38,0)", ("n", "leaves", "saved")


def turns(conversations: DataFrame) -> DataFrame:
    """(c, turn, x, n): x names role and text, n is the text's code points; null role or text becomes empty."""
    role, text = text_or_empty("role"), text_or_empty("text")
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("turn"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("x"), F.length(text).cast("long").alias("n"))


def rebuilt(found: DataFrame, family: int | None = FAMILY) -> tuple[DataFrame, DataFrame]:
    """Turns (c, d, x, n, last) with their depth from 1, last where the conversation ends, and the ids (c) of conversations without turns.

    A conversation starts with the first turns of the first one of its family, as many as a hash of its id says, in place of as many of its
    own. Without a family, conversations stay as they are. Turns of one number are in order of x.
    """
    held = in_order(found, F.col("c"), F.col("turn").asc_nulls_first(), F.col("x"))
    spans = written(held.groupBy("_part", "c").agg(F.count(F.lit(1)).alias("k"), F.min("_place").alias("low")), "spans")
    sizes = spans.groupBy("c").agg(F.sum("k").alias("size"))
    if family:
        first = F.col("c") - F.col("c") % family
        bases = sizes.select(F.col("c").alias("base"), F.col("size").alias("base_size"))
        asked = F.crc32(F.col("c").cast("string").cast("binary")) % SHARED
        plans = sizes.withColumns({"base": first, "asked": asked}).join(bases, "base", "left").withColumn("taken", F.least("asked", F.coalesce("base_size", F.lit(0))))
    else:
        plans = sizes.withColumns({"base": F.col("c"), "asked": F.lit(0).cast("long"), "taken": F.lit(0).cast("long")})
    plans = written(plans.select("c", "size", "base", "asked", "taken"), "plans")
    before = F.coalesce(F.sum("k").over(Window.partitionBy("c").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = spans.withColumn("before", before).join(plans, "c").drop("k")
    numbered = held.join(placed, ["_part", "c"]).withColumn("at", F.col("_place") - F.col("low") + F.col("before"))
    numbered = written(numbered.select("c", "at", "x", "n", "size", "base", "asked", "taken"), "numbered")
    own = numbered.where((F.col("c") == F.col("base")) | (F.col("at") >= F.col("asked")))
    depth = F.when(F.col("c") == F.col("base"), F.col("at")).otherwise(F.col("taken") + F.col("at") - F.col("asked")) + 1
    own = own.select("c", depth.alias("d"), "x", "n", (F.col("at") == F.col("size") - 1).alias("last"))
    if not family:
        return own, plans.where("false").select("c")
    given = numbered.where((F.col("c") == F.col("base")) & (F.col("at") < SHARED - 1)).select("base", "at", "x", "n")
    ends = (F.col("size") <= F.col("asked")) & (F.col("at") + 1 == F.col("taken"))
    copies = plans.where("c <> base and taken > 0").join(given, "base").where("at < taken").select("c", (F.col("at") + 1).alias("d"), "x", "n", ends.alias("last"))
    return own.unionByName(copies), plans.where("c <> base and taken = 0 and size <= asked").select("c")


def prefixes(rows: DataFrame) -> DataFrame:
    """(c, d, n, last, a, b, up_a, up_b): each turn with the name (a, b) of the prefix that it ends and of the one before it."""
    held = in_order(rows, "c", "d")
    own = [F.xxhash64(F.lit(seed), F.col("d"), F.col("x")).cast(_NAME) for seed in (1, 2)]
    held = held.withColumns({"h_a": own[0], "h_b": own[1]})
    totals = held.groupBy("_part", "c").agg(F.sum("h_a").alias("t_a"), F.sum("h_b").alias("t_b"))
    earlier = Window.partitionBy("c").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_part", "c", *(F.coalesce(F.sum(f"t_{s}").over(earlier), F.lit(0)).cast(_NAME).alias(f"c_{s}") for s in "ab"))
    running = Window.partitionBy("_part", "c").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    summed = held.withColumns({s: F.sum(f"h_{s}").over(running) for s in "ab"}).join(carried, ["_part", "c"])
    names = {s: (F.col(s) + F.col(f"c_{s}")).cast(_NAME) for s in "ab"}
    ups = {f"up_{s}": (names[s] - F.col(f"h_{s}")).cast(_NAME) for s in "ab"}
    return written(summed.select("c", "d", "n", "last", *(x.alias(k) for k, x in (names | ups).items())), "prefixes")


def ranked(arcs: DataFrame, last: int = LAST) -> DataFrame:
    """List ranking with weights. arcs: (id, next, n, leaves, saved), one list, null next at its end; returns (id, n, leaves, saved): the sums
    over all arcs before each.

    In a round every arc throws a coin; an arc of tails whose predecessor has heads is taken out, its weights go to the predecessor. A
    quarter of the list goes each time in one join on unique keys, so all rounds together move about four times the list.
    A list of at most `last` arcs is walked in one task. Then the rounds are undone: an arc taken out follows its predecessor.
    """
    spark = arcs.sparkSession
    rest, rounds = written(arcs, "arcs"), []
    while rest.count() > last:
        tails = F.xxhash64("id", F.lit(len(rounds))).bitwiseAND(F.lit(1)) == 1
        heads = rest.where(~tails).select(F.struct(*rest.columns).alias("a"), F.col("next").alias("meet"))
        met = written(heads.join(rest.where(tails).select(F.struct(*rest.columns).alias("b"), F.col("id").alias("meet")), "meet", "full").select("a", "b"), "met")
        both = F.col("a").isNotNull() & F.col("b").isNotNull()
        one = F.coalesce("a", "b")
        rounds.append(met.where(both).select(F.col("b.id").alias("id"), F.col("a.id").alias("before"), *(F.col(f"a.{s}").alias(s) for s in _SUMS)))
        rest = met.select(one["id"].alias("id"), F.when(both, F.col("b.next")).otherwise(one["next"]).alias("next"), *(F.when(both, F.col(f"a.{s}") + F.col(f"b.{s}")).otherwise(one[s]).alias(s) for s in _SUMS))
        rest = written(rest, "arcs")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        if not frames:
            return
        table = pd.concat(frames)
        following = {i: (None if pd.isna(nxt) else int(nxt), w) for i, nxt, *w in table[["id", "next", *_SUMS]].itertuples(index=False)}
        at = (set(following) - {x[0] for x in following.values()}).pop()
        sums, out = [0, 0, 0], []
        while at is not None:
            nxt, own = following[at]
            out.append((at, *sums))
            sums = [a + int(b) for a, b in zip(sums, own)]
            at = nxt
        yield pd.DataFrame(out, columns=["id", *_SUMS])

    found = written(rest.coalesce(1).mapInPandas(walk, "id long, n long, leaves long, saved long"), "ranks")
    for gone in reversed(rounds):
        ahead = found.select(F.col("id").alias("before"), *(F.col(s).alias(f"to_{s}") for s in _SUMS))
        found = written(found.unionByName(gone.join(ahead, "before").select("id", *((F.col(s) + F.col(f"to_{s}")).alias(s) for s in _SUMS))), "ranks")
    return found


def digests(ends: DataFrame) -> DataFrame:
    """(d, a, b, ends_sha256): SHA-256 of each node's ids (c) in order, joined by commas. Ids of a node are joined part by part where they
    lie in order; only these strings meet, in order, in a digest that goes on from one to the next and holds one at a time."""
    parts = in_order(ends, "d", "a", "b", "c").groupBy("_part", "d", "a", "b").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("c")), lambda c: c.cast("string"))).alias("ids"))
    met = parts.repartition("d", "a", "b").sortWithinPartitions("d", "a", "b", "_part")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = None, None
        for batch in batches:
            out = []
            for d, a, b, ids in batch[["d", "a", "b", "ids"]].itertuples(index=False):
                if (d, a, b) == name:
                    state.update(b"," + ids.encode())
                    continue
                if state:
                    out.append((*name, state.hexdigest()))
                name, state = (d, a, b), hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=["d", "a", "b", "ends_sha256"])
        if state:
            yield pd.DataFrame([(*name, state.hexdigest())], columns=["d", "a", "b", "ends_sha256"])

    return met.mapInPandas(digest, f"d long, a {_NAME}, b {_NAME}, ends_sha256 string")


def trie(conversations: DataFrame, family: int | None = None, last: int = LAST) -> DataFrame:
    """One row per node of the trie of all conversations (conv_id, turn, role, text): conv_id (smallest member), depth, parent_conv_id (root:
    null), n_convs (members), n_children, n_leaves (childless nodes of the subtree), saved_tokens (over the subtree, (n_convs - 1) times
    the code points of each node's last text), ends_sha256 (of the decimal ids that end there, ascending, comma-joined).

    A conversation's turns are in order of their number, null first; turns of one number in order of the MD5 of role and text; repeated
    rows are turns like any other. Null role or text is empty. Rows without a conv_id are in no conversation and are left out. family:
    see rebuilt(). Other columns are ignored. Very long texts are hashed where they lie and not moved; a conversation of very many
    turns is dealt to many tasks. An empty table gives no rows, without a root.
    """
    rows, turnless = rebuilt(turns(conversations), family)
    named = prefixes(rows)
    zero = F.lit(0).cast(_NAME)
    root_ends = written(turnless.select(F.lit(0).cast("long").alias("d"), zero.alias("a"), zero.alias("b"), "c"), "turnless")
    # the root holds all conversations, each of which ends once
    ends = named.where("last").select("d", "a", "b", "c").unionByName(root_ends)
    least, n = ends.agg(F.min("c"), F.count(F.lit(1))).first()
    root = conversations.sparkSession.range(1 if n else 0).select(
        F.lit(0).cast("long").alias("d"), zero.alias("a"), zero.alias("b"), F.lit(least).cast("long").alias("conv"), F.lit(n).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("chars"), F.lit(None).cast("long").alias("up_conv")
    )
    nodes = written(named.groupBy("d", "a", "b").agg(F.min("c").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("n").alias("chars"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b")), "nodes")
    above = nodes.select((F.col("d") + 1).alias("d"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv").alias("up_conv"))
    deeper = nodes.where("d > 1").join(above, ["d", "up_a", "up_b"]).drop("up_a", "up_b")
    top = nodes.where("d = 1").drop("up_a", "up_b").withColumn("up_conv", F.lit(least).cast("long"))
    ordered = in_order(deeper.unionByName(top).unionByName(root), F.col("up_conv").asc_nulls_first(), "d", "conv")
    # as many rows as parts
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("k"))
    starts = sizes.select("_part", F.coalesce(F.sum("k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    numbered = written(ordered.join(F.broadcast(starts), "_part").withColumn("i", F.col("start") + F.col("_place")).drop("start", "_part", "_place"), "numbered-nodes")
    children = numbered.where("d > 0").groupBy(F.col("up_conv").alias("conv"), (F.col("d") - 1).alias("d")).agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n_children"))
    nodes = numbered.join(children, ["conv", "d"], "left").fillna(0, ["n_children"])
    nodes = written(nodes, "nodes-with-children")
    parents = written(nodes.where("n_children > 0").select(F.col("conv").alias("up_conv"), (F.col("d") + 1).alias("d"), F.col("i").alias("up"), (F.col("first") + F.col("n_children") - 1).alias("up_last")), "parents")
    into = nodes.select((2 * F.col("i")).alias("id"), F.when(F.col("n_children") > 0, 2 * F.col("first")).otherwise(2 * F.col("i") + 1).alias("next"), F.lit(1).cast("long").alias("n"), (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    none = [F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")]
    onward = F.when(F.col("i") == F.col("up_last"), 2 * F.col("up") + 1).otherwise(2 * (F.col("i") + 1))
    out_of = nodes.where("d > 0").join(parents, ["up_conv", "d"]).select((2 * F.col("i") + 1).alias("id"), onward.alias("next"), *none)
    end = nodes.where("d = 0").select((2 * F.col("i") + 1).alias("id"), F.lit(None).cast("long").alias("next"), *none)
    sums = ranked(into.unionByName(out_of).unionByName(end), last)
    signed = lambda s: F.sum(F.when(F.col("id") % 2 == 1, F.col(s)).otherwise(-F.col(s)))
    totals = sums.groupBy(F.shiftright("id", 1).alias("i")).agg(signed("leaves").alias("n_leaves"), signed("saved").alias("saved_tokens"))
    found = nodes.join(totals, "i").join(digests(ends), ["d", "a", "b"], "left")
    return found.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.col("up_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )
