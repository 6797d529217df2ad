"""Mixing sources to target weights: temperature, bisected exponent, budgeted block permutations.

A source's weight is its token share raised to an exponent and normalised.  The exponent is the
largest at which the weights keep a target entropy, or the smallest at which no source repeats
more often than allowed, found by bisection between 0 (all alike) and 1 (as the corpus is).
Weights times the budget give each source's tokens.  A source deals its documents in one seeded
permutation per epoch until its tokens are used; the row that crosses the budget is the last.
The dealt stream is cut into blocks, each with every source's share of it.

All steps are DataFrame expressions.  Running token sums go over hash buckets of the permutation
key, so that a hot source is summed in ``BUCKETS`` parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from benchloom.llm.common import pick
from benchloom.sizing import broadcast_if_small

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096
BISECTIONS = 40
DRAW_BITS = 60
BLOCK_TOKENS = 1 << 16
SEED = 42


def words(text: Column) -> Column:
    """Words of a text plus one for its end; 1 for null and empty texts."""
    return (F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)) + 1).cast("bigint")


def draw(doc_id: Column, epoch: Column | int, seed: int = SEED) -> Column:
    """The document's 60-bit place in the permutation of an epoch."""
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, DRAW_BITS // 4), 16, 10).cast("bigint")


def weights(totals: DataFrame, entropy: float | None = None, repetitions: float | None = None, budget: int | None = None) -> DataFrame:
    """(source, tokens, exponent, weight, allotted, full, rest) from ``totals`` (source, tokens), a row per source.

    ``entropy``: fraction of the greatest entropy, ln of the number of sources, that the weights
    shall reach.  ``repetitions``: how often at most a source is read.  Give one of them.
    ``budget``: tokens in all, by default as many as there are.  ``full`` epochs and ``rest``
    tokens of another make up ``allotted``.  If even exponent 1 (0) meets the target it is taken;
    a limit no exponent meets gives exponent 1.  The list of sources, a few bytes each, is one
    row; an empty table gives no rows.
    """
    if (entropy is None) == (repetitions is None):
        raise ValueError("give either entropy or repetitions")
    row = totals.agg(F.sort_array(F.collect_list(F.struct("source", "tokens"))).alias("s"), F.sum("tokens").alias("total"))
    row = row.filter("total > 0").withColumn("budget", F.lit(budget).cast("bigint") if budget else F.col("total"))
    shares = row.withColumn("p", F.transform("s", lambda x: x["tokens"] / F.col("total")))

    def sum_of(f) -> Column:
        return F.aggregate("p", F.lit(0.0), lambda acc, p: acc + f(p))

    def meets(a: Column) -> Column:
        z = sum_of(lambda p: F.pow(p, a))
        if entropy is not None:
            h = F.log(z) - a * sum_of(lambda p: F.pow(p, a) * F.log(p)) / z
            return h >= F.lit(entropy) * F.log(F.size("p").cast("double")) - 1e-12
        # weight * budget / tokens is greatest for the smallest share
        least = F.array_min("p")
        return F.pow(least, a) / z * F.col("budget") / (least * F.col("total")) <= F.lit(repetitions) + 1e-12

    low, high = F.lit(0.0), F.lit(1.0)
    start = F.struct(low.alias("lo"), high.alias("hi"))

    def halve(state: Column, _: Column) -> Column:
        mid = (state["lo"] + state["hi"]) / 2
        up = meets(mid) if entropy is not None else ~meets(mid)  # move the lower bound
        return F.struct(F.when(up, mid).otherwise(state["lo"]).alias("lo"), F.when(up, state["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), start, halve)
    if entropy is not None:
        exponent = F.when(meets(F.lit(1.0)), F.lit(1.0)).otherwise(found["lo"])
    else:
        exponent = F.when(meets(F.lit(0.0)), F.lit(0.0)).otherwise(found["hi"])
    solved = shares.withColumn("exponent", F.round(exponent, 9))
    solved = solved.withColumn("z", sum_of(lambda p: F.pow(p, F.col("exponent"))))
    each = solved.select("exponent", "z", "total", "budget", F.inline("s"))
    weight = F.pow(F.col("tokens") / F.col("total"), F.col("exponent")) / F.col("z")
    each = each.filter("tokens > 0").select("source", "tokens", "exponent", weight.alias("weight"), F.round(weight * F.col("budget")).cast("bigint").alias("allotted"), "budget")
    return each.withColumns({"full": F.expr("allotted div tokens"), "rest": F.expr("allotted % tokens")})


def source_totals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, source, n_tokens) and each source's tokens (source, tokens); a null source is a source."""
    rows = pick(docs, **{id_col: "bigint", text_col: "string", source_col: "string"}).toDF("doc_id", "text", "source")
    rows = rows.select("doc_id", "source", words(F.col("text")).alias("n_tokens"))
    return rows, rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))


def realise(rows: DataFrame, plan: DataFrame, seed: int = SEED, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, source, epoch, block, draw, n_tokens) of every row dealt, from ``source_totals`` and ``weights``.

    Order by block, then draw, for the training order.  A document is dealt while the tokens of
    its source before it are fewer than allotted; equal ids are dealt one after the other.
    """
    plan = broadcast_if_small(plan.select(F.col("source").alias("s"), "tokens", "allotted", "budget"))
    dealt = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).filter("allotted > 0")
    epochs = F.sequence(F.lit(0).cast("bigint"), F.expr("(allotted - 1) div tokens"))
    dealt = dealt.select("doc_id", "source", "n_tokens", "tokens", "allotted", "budget", F.explode(epochs).alias("epoch"))
    dealt = dealt.withColumn("epoch", F.col("epoch").cast("int")).withColumn("draw", draw(F.col("doc_id"), F.col("epoch"), seed))
    dealt = dealt.withColumn("bucket", F.shiftright("draw", DRAW_BITS - 12).cast("int"))
    parts = ["source", "epoch", "bucket"]
    sums = dealt.groupBy(*parts).agg(F.sum("n_tokens").alias("n"))
    before = W.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"r_{c}") for c in parts], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy(*parts).orderBy("draw", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("r_source")) & (F.col("epoch") == F.col("r_epoch")) & (F.col("bucket") == F.col("r_bucket"))
    at = F.col("epoch") * F.col("tokens") + F.col("offset") + F.col("own")
    kept = placed.join(sums, same).withColumn("at", at).filter("at < allotted")
    blocks = F.greatest(F.expr(f"budget div {block_tokens}"), F.lit(1))
    block = F.floor(F.col("at").cast("double") * blocks / F.col("allotted")).cast("bigint")
    return kept.select("doc_id", "source", "epoch", block.alias("block"), "draw", "n_tokens")


def mix(docs: DataFrame, entropy: float | None = None, repetitions: float | None = None, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` with every row as often as the mixture deals it; all columns as they were.

    The texts are not shuffled: ``realise`` settles, per source, the last place dealt of the
    epoch that is not read in full, and each row compares its own place with that.
    """
    rows, totals = source_totals(docs)
    plan = weights(totals, entropy, repetitions, budget)
    last = realise(rows, plan, seed).groupBy("source").agg(F.max(F.struct("epoch", "draw", "doc_id")).alias("last"))
    last = broadcast_if_small(last.select(F.col("source").alias("__mix_source"), F.col("last").alias("__mix_last")))
    joined = docs.join(last, docs["source"].cast("string").eqNullSafe(F.col("__mix_source")))
    epoch = F.col("__mix_last.epoch")
    id_ = docs["doc_id"].cast("bigint")
    own = F.struct(draw(id_, epoch, seed).alias("draw"), id_.alias("doc_id"))
    edge = F.struct(F.col("__mix_last.draw").alias("draw"), F.col("__mix_last.doc_id").alias("doc_id"))
    copies = epoch + F.when(own <= edge, 1).otherwise(0)
    many = joined.withColumn("__mix_copy", F.explode(F.sequence(F.lit(0), copies))).filter("__mix_copy > 0")
    return many.select(*[docs[c] for c in docs.columns])
