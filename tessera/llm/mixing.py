"""Operator 10, mixing sources to target weights: Pareto order sampling after whole copies.

A source with weight w gets n = w * total documents (largest remainders make up the total). Within it
a document of size x is due e = n x / sum(x) copies: floor(e) of them are certain, and for the rest the
sample is of fixed size with inclusion chances p = e - floor(e). Pareto order sampling takes the
documents of least (u / (1 - u)) / (p / (1 - p)), u uniform and drawn from a hash of doc_id.

The cut in that order is found without sorting a source: counts by bucket of q / (1 + q) lead to the
bucket that holds the cut, and only its rows are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import _shared

SEED = "mix-1"
BUCKETS = 1 << 16
#: Stands for a null source, which is a source of its own.
NULL_SOURCE = "\x01null"


def _source() -> Column:
    return F.coalesce(F.col("source"), F.lit(NULL_SOURCE))


def _size() -> Column:
    """The number of binary digits of the length in characters: long documents are due a little more."""
    return F.length(F.bin(F.coalesce(F.length("text"), F.lit(0)).cast("bigint"))).cast("bigint")


def quotas(sizes: DataFrame, weights: dict[str | None, float] | None, total: int | None) -> DataFrame:
    """(src, n, x, quota) from (src, n, x). Sources that `weights` doesn't name get 0; None: all the same."""
    spark = sizes.sparkSession
    if weights is None:
        given = sizes.select("src", F.lit(1.0).alias("weight"))
    else:
        rows = [(NULL_SOURCE if k is None else k, float(v)) for k, v in weights.items() if v > 0]
        given = spark.createDataFrame(rows, "src string, weight double")
    joined = sizes.join(given, "src", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    everything, order = Window.partitionBy(), Window.partitionBy().orderBy(F.desc("rest"), "src")  # a row for each source
    share = joined.withColumn("whole", F.sum("weight").over(everything)).withColumn("total", F.lit(total).cast("bigint") if total is not None else F.sum("n").over(everything))
    exact = F.when(F.col("whole") > 0, F.col("total") * F.col("weight") / F.col("whole")).otherwise(0.0)
    part = share.withColumn("exact", F.round(exact, 9)).withColumn("base", F.floor("exact")).withColumn("rest", F.col("exact") - F.col("base"))
    left = F.when(F.col("whole") > 0, F.col("total") - F.sum("base").over(everything)).otherwise(0)
    ranked = part.withColumn("left", left).withColumn("r", F.row_number().over(order))
    return ranked.select("src", "n", "x", (F.col("base") + F.when(F.col("r") <= F.col("left"), 1).otherwise(0)).alias("quota"))


def _narrow(docs: DataFrame, **keep: Column) -> DataFrame:
    """keep and, for each row, id, src, size and u, uniform in (0, 1)."""
    digits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("bigint")
    return docs.select(*[c.alias(k) for k, c in keep.items()], F.col("doc_id").alias("id"), _source().alias("src"), _size().alias("size"), ((digits + 0.5) / float(1 << 48)).alias("u"))


def _drawn(rows: DataFrame, quota: DataFrame) -> DataFrame:
    """rows of `_narrow` with whole (certain copies), chance, q (the rank variable; null without a chance) and bucket (of q)."""
    due = rows.join(quota, "src").withColumn("due", F.col("quota") * F.col("size") / F.col("x"))
    chance = due.withColumn("whole", F.floor("due")).withColumn("chance", F.col("due") - F.col("whole"))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("chance") / (1 - F.col("chance")))
    drawn = chance.withColumn("q", F.when(F.col("chance") > 0, odds))
    return drawn.withColumn("bucket", F.floor(F.col("q") / (1 + F.col("q")) * BUCKETS))


def _cut(rows: DataFrame, weights: dict | None, total: int | None) -> tuple[DataFrame, DataFrame, bool]:
    """(quotas, cuts, whether equal rows lie across a cut) from the rows of `_narrow`; both have a row for each source.

    A cut is the bucket `edge`, the last row (q, id, size) that is taken within it, how many `equal` it, and how
    many of these, `some`, are taken.
    """
    sizes = rows.groupBy("src").agg(F.count("*").alias("n"), F.sum("size").alias("x"))
    quota = _shared.materialize(quotas(sizes, weights, total), "quotas")
    sources = quota.count()
    drawn = _drawn(rows, _shared.small(quota, sources))
    # how many copies each source still needs, and in which bucket the last of them lies
    counts = _shared.materialize(drawn.groupBy("src", "bucket").agg(F.count("*").alias("rows"), F.sum("whole").alias("whole")), "counts")
    need = quota.join(counts.groupBy("src").agg(F.sum("whole").alias("whole")), "src").select("src", (F.col("quota") - F.col("whole")).alias("need"))
    upto = F.sum("rows").over(Window.partitionBy("src").orderBy("bucket"))
    edge = counts.where("bucket is not null").withColumn("upto", upto).join(need, "src").where("upto - rows < need and upto >= need").select("src", F.col("bucket").alias("edge"), (F.col("need") - F.col("upto") + F.col("rows")).alias("left"))
    edge = _shared.materialize(need.join(edge, "src", "left").select("src", F.when(F.col("need") <= 0, -1).otherwise(F.coalesce("edge", F.lit(BUCKETS))).alias("edge"), F.coalesce("left", F.lit(0)).alias("left")), "edges")
    # only the rows of that bucket are ranked
    r = F.row_number().over(Window.partitionBy("src").orderBy("q", "id", "size"))
    inside = drawn.join(_shared.small(edge, sources), "src").where("bucket = edge").select("src", "left", F.struct("q", "id", "size").alias("mine"), r.alias("r"))
    last = F.max(F.when(F.col("r") <= F.col("left"), F.col("mine"))).over(Window.partitionBy("src"))
    inside = inside.withColumn("last", last).groupBy("src").agg(F.first("last").alias("last"), F.count_if(F.col("mine") == F.col("last")).alias("equal"), F.count_if(F.col("mine") < F.col("last")).alias("under"))
    cut = edge.join(inside, "src", "left").select("src", "edge", "last", F.coalesce("equal", F.lit(0)).alias("equal"), (F.col("left") - F.coalesce("under", F.lit(0))).alias("some"))
    cut = _shared.materialize(cut, "cuts")
    partial = not cut.where("equal > some").isEmpty()
    _shared.release(counts, edge)
    return _shared.small(quota, sources), _shared.small(cut, sources), partial


def _copied(rows: DataFrame, keep: list[str], quota: DataFrame, cut: DataFrame, partial: bool) -> DataFrame:
    """keep, src and copies, for each row of `_narrow`."""
    rows, mine = _drawn(rows, quota).join(cut, "src"), F.struct("q", "id", "size")
    taken = F.when(F.col("bucket") < F.col("edge"), 1).when((F.col("bucket") == F.col("edge")) & (mine <= F.col("last")), 1).otherwise(0)
    out = lambda df, one: df.select(*keep, "src", (F.col("whole") + one).cast("int").alias("copies"))
    if not partial:
        return out(rows, taken)
    # rows repeated across the cut: so many of them as are still needed
    tie = F.coalesce((F.col("bucket") == F.col("edge")) & (mine == F.col("last")) & (F.col("equal") > F.col("some")), F.lit(False))
    r = F.row_number().over(Window.partitionBy("src").orderBy("q"))
    return out(rows.where(~tie), taken).unionAll(out(rows.where(tie).withColumn("r", r), F.when(F.col("r") <= F.col("some"), 1).otherwise(0)))


def sample(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None) -> DataFrame:
    """(doc_id, source, copies), one row for each row of docs: how often it is in the mixture.

    weights: source to weight, needn't sum to 1; a source that it doesn't name gets no copies; None: all
    sources weigh the same. total: the size of the mixture; None: as many as docs. A null source is a
    source of its own. Null texts count as empty, and empty ones have size 1. Null ids share one draw.
    Ties in the order go by doc_id, then size; of equal rows at the cut any may be taken, so that sizes
    are exact. An empty table gives an empty result; other columns aren't looked at.
    """
    rows = _shared.materialize(_narrow(docs), "drawn")  # texts are read once
    got = _copied(rows, ["id"], *_cut(rows, weights, total))
    return got.select(F.col("id").alias("doc_id"), F.when(F.col("src") != NULL_SOURCE, F.col("src")).alias("source"), "copies")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None) -> DataFrame:
    """The mixture itself: each row of docs as often as `sample` has it, with its own columns."""
    rows = _shared.materialize(_narrow(docs), "drawn")
    cuts = _cut(rows, weights, total)
    _shared.release(rows)
    got = _copied(_narrow(docs, row=F.struct(*docs.columns)), ["row"], *cuts)
    return got.where("copies > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
