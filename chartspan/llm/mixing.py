"""Mixing sources to target weights by temperature, as budgeted block permutations (operator 6).

DataFrame functions only.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartspan.llm.common import SPACES, written

#: Rows of a source that are permuted and dealt out together, about.
BLOCK_ROWS = 512
#: Halvings of the exponent's range that one pass over the sources decides, and passes.
HALVINGS, PASSES = 5, 6
NO_SOURCE = "\u0000"
#: Bits of the number of blocks whose sizes are added up in one task.
STRETCH = 10


def n_tokens(text: Column) -> Column:
    """Words, the native measure of a text's size; null counts as none. mix() takes another measure, as a tokenizer's counts, as a column."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, tokens: Column | None, seed: int) -> list[Column]:
    """(source, tokens, place by hash) of a row. The hash is of id and text, so that rows without an id fall apart as well."""
    size = n_tokens(F.col(text_col)) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))
    return [F.coalesce(F.col(source_col), F.lit(NO_SOURCE)).alias("source"), size.alias("tokens"), F.xxhash64(F.col(id_col), F.xxhash64(F.col(text_col)), F.lit(seed)).alias("h")]


def shares(rows: DataFrame) -> DataFrame:
    """(source, docs, tokens, share) of sources, one row each, from rows of (source, tokens); a source without a token has share 0."""
    sizes = written(rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens")), "sources")
    total = sizes.agg(F.greatest(F.sum("tokens"), F.lit(1)).alias("_all"))  # one row
    return sizes.join(F.broadcast(total)).withColumn("share", F.col("tokens") / F.col("_all")).drop("_all")


def _measures(sources: DataFrame, exponents: list[float], budget: float | None) -> dict[float, tuple[float, float]]:
    """exponent -> (entropy of the weights, most repetitions of a source), in one pass over the sources that have tokens."""
    tried = sources.where("share > 0").withColumn("t", F.explode(F.array(*map(F.lit, exponents)))).withColumn("w", F.pow("share", "t"))
    per = F.col("w") / F.col("share")
    rows = tried.groupBy("t").agg(
        F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("wlog"), F.max(per).alias("most"), F.min(per).alias("least"), F.max(F.col("tokens") / F.col("share")).alias("all")
    )
    out = {}
    for r in rows.collect():  # a row for each exponent tried
        repeats = r["most"] / r["least"] if budget is None else budget / r["all"] * r["most"] / r["z"]
        out[r["t"]] = (0.0 if not r["z"] else float(log(r["z"]) - r["wlog"] / r["z"]), repeats)
    return out


def exponent(sources: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: float | None = None) -> float:
    """Bisects [0, 1] for the exponent at which the weights have the entropy, or else for the least (the flattest weights) at
    which no source is repeated more often than `repeats`. Both measures fall as the exponent grows. A pass evaluates all
    exponents that the next HALVINGS halvings may ask for."""
    low, high = 0.0, 1.0
    enough = (lambda m: m[0] <= entropy) if entropy is not None else (lambda m: m[1] <= repeats)
    ends = _measures(sources, [0.0, 1.0], budget)
    if not ends or enough(ends[0.0]):
        return 0.0
    if not enough(ends[1.0]):
        return 1.0
    for _ in range(PASSES):
        n = 2**HALVINGS
        grid = [low + (high - low) * k / n for k in range(1, n)]
        seen = _measures(sources, grid, budget)
        a, b = 0, n
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (a, mid) if enough(seen[grid[mid - 1]]) else (mid, b)
        low, high = low + (high - low) * a / n, low + (high - low) * b / n
    return high


def weights(sources: DataFrame, t: float, budget: float | None = None) -> DataFrame:
    """sources with (weight, quota in tokens). Without a budget, the least at which every source is wholly in once. A source without a
    token has weight and quota 0."""
    raised = sources.withColumn("_w", F.when(F.col("share") > 0, F.pow("share", F.lit(t))).otherwise(0.0))
    z = raised.agg(F.sum("_w").alias("_z"), F.max(F.when(F.col("_w") > 0, F.col("tokens") * 1.0 / F.col("_w"))).alias("_scale"))  # one row
    out = raised.join(F.broadcast(z)).withColumn("weight", F.when(F.col("_w") > 0, F.col("_w") / F.col("_z")).otherwise(0.0))
    size = F.lit(float(budget)) * F.col("weight") if budget is not None else F.coalesce(F.col("_scale") * F.col("_w"), F.lit(0.0))
    return out.withColumn("quota", F.greatest(F.round(size), F.lit(0)).cast("long")).drop("_w", "_z", "_scale")


def _block(h: Column, n: Column) -> Column:
    return F.pmod(h, n).cast("long")


def _blocks(docs: Column, block_rows: int) -> Column:
    """A power of two, so that each source has blocks of half to all of block_rows rows, about."""
    n = F.ceil(docs / block_rows)
    return F.when(n <= 1, F.lit(1)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n - 1)))).cast("long")


def _turn(block: Column, blocks: Column, source: Column, epoch: Column) -> Column:
    """The block's place, from 0, in an epoch of its source: a permutation of the blocks drawn by a hash of source and epoch. Steps that
    can each be undone within the bits of `blocks`, so no list of places is kept anywhere."""
    key, mask = F.xxhash64(source, epoch.cast("long")), blocks - 1
    half = F.greatest(F.lit(1), F.ceil((F.length(F.bin(blocks)) - 1) / 2)).cast("int")
    x = block.bitwiseXOR(key.bitwiseAND(mask))
    for bit in (3, 25):
        odd = 2 * F.shiftrightunsigned(key, bit).bitwiseAND(F.lit((1 << 18) - 1)) + 1
        x = (x * odd).bitwiseAND(mask)
        x = x.bitwiseXOR(F.call_function("shiftrightunsigned", x, half))
    return x


def plan(rows: DataFrame, quotas: DataFrame, block_rows: int = BLOCK_ROWS, empty_epochs: int = 1) -> DataFrame:
    """(source, quota, all, blocks, epochs, cut, end) from rows of (source, tokens, h), one row for each source of quotas.

    A source is dealt by hash to blocks of about block_rows rows. A quota is whole epochs of all its blocks and, in the last
    epoch, the blocks before place `cut` of its order and of the one there the rows whose hash is at most `end`, the last of which
    may go beyond the quota. Sums over the blocks are taken by STRETCH places and then over stretches, so the hottest source costs a
    row per block and no task orders all of them; copies of a row are one place. A source without a token comes in empty_epochs times.
    """
    each = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(empty_epochs)
    known = written(quotas.select("source", "quota", F.col("tokens").alias("all"), _blocks(F.col("docs"), block_rows).alias("blocks"), each.alias("epochs")), "epochs")
    turn = _turn(_block(F.col("h"), F.col("blocks")), F.col("blocks"), F.col("source"), F.col("epochs") + 1)
    placed = rows.join(known.select("source", "blocks", "epochs"), "source").select("source", "tokens", "h", turn.alias("turn"))
    stretch = F.shiftright("turn", STRETCH)
    sizes = written(placed.groupBy("source", "turn").agg(F.sum("tokens").alias("size")).withColumn("stretch", stretch), "block-sizes")
    earlier = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    sums = sizes.groupBy("source", "stretch").agg(F.sum("size").alias("s"))
    sums = sums.select("source", "stretch", F.coalesce(F.sum("s").over(earlier(["source"], "stretch")), F.lit(0)).alias("above"))
    within = F.coalesce(F.sum("size").over(earlier(["source", "stretch"], "turn")), F.lit(0))
    before = sizes.withColumn("within", within).join(sums, ["source", "stretch"]).join(known, "source")
    short = before.withColumn("room", F.col("quota") - F.col("epochs") * F.col("all") - F.col("above") - F.col("within")).where("room < size and all > 0")
    cut = written(short.groupBy("source").agg(F.min(F.struct("turn", "room")).alias("c")).select("source", F.col("c.turn").alias("cut"), F.col("c.room").alias("room")), "cuts")  # room falls from place to place
    places = placed.join(cut.select("source", F.col("cut").alias("turn"), "room").where("room > 0"), ["source", "turn"]).groupBy("source", "room", "h").agg(F.sum("tokens").alias("n"))
    run = F.coalesce(F.sum("n").over(earlier(["source"], "h")), F.lit(0))
    ends = places.withColumn("run", run).where("run < room").groupBy("source").agg(F.max("h").alias("end"))
    return written(known.join(cut.select("source", "cut"), "source", "left").join(ends, "source", "left"), "plan")


def realise(docs: DataFrame, planned: DataFrame, measures: list[Column]) -> DataFrame:
    """The rows of docs as often as their source's quota asks, with `mix_epoch`, `mix_block`, `mix_slot` and `mix_tokens`.

    mix_slot in [0, 1) orders the mix: a source's epochs and, in them, its blocks follow each other over it, blocks in an order of the
    epoch's own and rows permuted within their block, so that every stretch has the weights. The last epoch is cut in its
    order. Rows meet one row of their source's plan and move no further.
    """
    row = docs.select(F.struct("*").alias("row"), F.struct(*measures).alias("m"))  # so that no name clashes
    dealt = row.join(planned.select(F.struct("*").alias("b")), F.col("m.source") == F.col("b.source"))
    dealt = dealt.withColumn("block", _block(F.col("m.h"), F.col("b.blocks")))
    turn = lambda epoch: _turn(F.col("block"), F.col("b.blocks"), F.col("m.source"), epoch)
    dealt = dealt.withColumn("turn", turn(F.col("b.epochs") + 1))
    last = F.coalesce((F.col("turn") < F.col("b.cut")) | ((F.col("turn") == F.col("b.cut")) & F.coalesce(F.col("m.h") <= F.col("b.end"), F.lit(False))), F.lit(False))
    copies = (F.col("b.epochs") + last.cast("long")).cast("int")
    out = dealt.where(copies > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1), copies)))
    within = F.pmod(F.xxhash64("m.h", "epoch"), F.lit(1_000_000)) / 1_000_000  # the order within a block changes with the epoch
    at = F.col("epoch") - 1 + (turn(F.col("epoch")) + within) / F.col("b.blocks")
    length = F.when(F.col("b.quota") > 0, F.col("b.quota") / F.col("b.all")).otherwise(F.greatest(F.col("b.epochs"), F.lit(1)))
    return out.select(
        *(F.col("row")[c].alias(c) for c in docs.columns), F.col("epoch").alias("mix_epoch"), F.col("block").cast("int").alias("mix_block"), F.least(at / length, F.lit(1 - 1e-9)).alias("mix_slot"), F.col("m.tokens").alias("mix_tokens")
    )


def mix(
    docs: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: float | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_rows: int = BLOCK_ROWS, seed: int = 1, tokens: Column | None = None
) -> DataFrame:
    """docs mixed to weights share ** exponent: see exponent() for the target, weights() for the budget, plan() and realise() for the rows.

    tokens: a column of docs with each text's token count, as op 1 gives it; by default words are counted. Rows keep all their
    columns, whatever their names; those named as the mix_ columns are replaced. Documents without a token count for nothing: they
    follow their block. A source without any token has weight 0: its rows are in once without a budget, and not with one. Null
    ids, null sources, very long texts and repeated rows are rows like any other. Rows of one id and text share a place: in the
    block where a quota ends they come in together. An empty table gives no rows.

    Texts are read twice: for (source, tokens, hash), written once, and for the rows themselves.
    """
    if (entropy is None) == (repeats is None):
        raise ValueError("either an entropy or a limit of repetitions")
    docs = docs.drop("mix_epoch", "mix_block", "mix_slot", "mix_tokens")
    measures = _measured(docs, id_col, text_col, source_col, tokens, seed)
    rows = written(docs.select(*measures), "sizes")
    sources = written(shares(rows), "shares")
    t = exponent(sources, entropy, repeats, budget)
    quotas = written(weights(sources, t, budget), "quotas")
    return realise(docs, plan(rows, quotas, block_rows, int(budget is None)), measures)
