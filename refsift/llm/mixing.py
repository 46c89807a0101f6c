"""Mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1. Each source has a weight schedule, piecewise
linear in time. Its integral is the source's weight, which fixes the source's
share of the token budget; the integral up to t is its cumulative token demand.
A document is needed when that demand reaches the document's place in its
source's stream, so inverting the demand gives its training position, and a
range sort by position gives the order of training.

All steps are joins, windows and aggregates on the JVM. Running sums over a
source never meet in one task: documents are put in random order by a hash and
dealt to blocks of about BLOCK_ROWS of them, whose sums are added level by level.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, whole

#: No source is taken more often than this.
MAX_EPOCHS = 3.0
BLOCK_ROWS = 64
#: A document is large if it holds more than one part in LARGE of its source's target.
LARGE = 64
#: Tables with a row for each source are broadcast up to so many; beyond that they are joined by shuffles.
FEW_SOURCES = 50_000
#: Entries of one level that are summed in one task, as a power of two.
FAN_BITS = 8

#: Shapes of the schedules by rank of the source, relative to its weight; each integrates to 1.
SHAPES = [[(0.0, 1.5), (1.0, 0.5)], [(0.0, 0.5), (1.0, 1.5)], [(0.0, 0.5), (0.5, 1.5), (1.0, 0.5)]]


def sizes(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size (words of the whole text; null: none), text_hash and more of every row."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.regexp_count(whole("text"), F.lit(WORD)).cast("long").alias("size"), F.xxhash64("text").alias("text_hash"), *more,
    )


def schedules(sources: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """The default curriculum for a table with a column source: sources by code point,
    null last, take the weights in turn, and with them the SHAPES.

    Returns source, knots (array of t, w). The rank is a window over the names of sources alone.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    knots = [
        F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w * weights[i % len(weights)]).alias("w")) for t, w in SHAPES[i % len(SHAPES)]])
        for i in range(len(weights) * len(SHAPES))
    ]
    return sources.select("source", rank.alias("rank")).select(
        "source", F.element_at(F.array(*knots), (F.pmod("rank", F.lit(len(knots))) + 1).cast("int")).alias("knots")
    )


def _integrated(knots: Column) -> Column:
    """Segments (t0, t1, w0, w1, a) of a schedule, with a the integral before t0."""
    pieces = F.transform(
        F.sequence(F.lit(1), F.size(knots) - 1),
        lambda i: F.struct(
            knots[i - 1]["t"].alias("t0"), knots[i]["t"].alias("t1"), knots[i - 1]["w"].alias("w0"), knots[i]["w"].alias("w1"),
        ),
    )
    start = F.array().cast("array<struct<t0:double,t1:double,w0:double,w1:double,a:double>>")
    area = lambda s: (s["t1"] - s["t0"]) * (s["w0"] + s["w1"]) / 2
    return F.aggregate(
        pieces, start,
        lambda done, s: F.concat(done, F.array(F.struct(
            s["t0"], s["t1"], s["w0"], s["w1"],
            F.coalesce(F.get(done, F.size(done) - 1)["a"] + area(F.get(done, F.size(done) - 1)), F.lit(0.0)).alias("a"),
        ))),
    )


def _inverse(segments: Column, demand: Column) -> Column:
    """The time at which the integral of the schedule reaches demand."""
    def solve(s: Column) -> Column:
        slope = (s["w1"] - s["w0"]) / (s["t1"] - s["t0"])
        need = F.greatest(demand - s["a"], F.lit(0.0))
        root = F.sqrt(F.greatest(s["w0"] * s["w0"] + 2 * slope * need, F.lit(0.0)))
        return F.least(s["t0"] + F.coalesce(F.try_divide(2 * need, s["w0"] + root), F.lit(0.0)), s["t1"])

    before = F.filter(segments, lambda s: s["a"] <= demand)
    return solve(F.element_at(before, -1))


def targets(stats: DataFrame, plan: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Add segments, weight and target to stats (source, source_size, rows).

    The budget is the size of all sources. Water-filling: a source whose share
    exceeds max_epochs of its size stops there, and the rest is shared by
    weight. With sources by size over weight, the first whose share doesn't exceed its
    limit sets the level for it and all after it.
    """
    joined = stats.join(plan.withColumnRenamed("source", "_source"), stats["source"].eqNullSafe(F.col("_source"))).drop("_source")
    joined = joined.withColumn("segments", _integrated(F.col("knots"))).withColumn(
        "weight", F.aggregate("segments", F.lit(0.0), lambda x, s: x + (s["t1"] - s["t0"]) * (s["w0"] + s["w1"]) / 2)
    )
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    earlier, onward = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(onward)
    return (
        joined.withColumn("cap", max_epochs * F.col("source_size"))
        .withColumn("level", level)
        .withColumn("order", F.struct((F.col("cap") / F.col("weight")).alias("ratio"), "level"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("order.ratio"), F.col("order"))).over(every)["level"])
        .withColumn("target", F.least("cap", F.col("level") * F.col("weight")))
        .select("source", "source_size", "rows", "segments", "weight", "target")
    )


def _offsets(docs: DataFrame, most: int) -> DataFrame:
    """Add before: the sizes of the documents that precede one in its source.

    docs: doc_id, source_no, size, h (hash), bits (of the hash that name the block). most: the largest bits.
    """
    levels = list(range(0, most + 1, FAN_BITS))
    leaf = docs.withColumn("block", F.when(F.col("bits") > 0, F.expr("shiftrightunsigned(h, 64 - bits)")).otherwise(F.lit(0)))
    tables = [leaf.groupBy("source_no", "bits", "block").agg(F.sum("size").alias("size"))]
    for _ in levels:
        up = F.greatest(F.col("bits") - FAN_BITS, F.lit(0))
        tables.append(
            tables[-1].groupBy("source_no", up.alias("bits"), F.expr(f"shiftright(block, bits - greatest(bits - {FAN_BITS}, 0))").alias("block"))
            .agg(F.sum("size").alias("size"))
        )
    above = None
    for t in reversed(tables[:-1]):
        up = F.greatest(F.col("bits") - FAN_BITS, F.lit(0))
        t = t.withColumn("parent", F.expr(f"shiftright(block, bits - greatest(bits - {FAN_BITS}, 0))")).withColumn("pbits", up)
        run = Window.partitionBy("source_no", "pbits", "parent").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        t = t.withColumn("base", F.coalesce(F.sum("size").over(run), F.lit(0)))
        if above is not None:
            a = above.select("source_no", F.col("bits").alias("pbits"), F.col("block").alias("parent"), F.col("base").alias("pbase"))
            t = t.join(a, ["source_no", "pbits", "parent"]).withColumn("base", F.col("base") + F.col("pbase"))
        above = t.select("source_no", "bits", "block", "base")
    within = Window.partitionBy("source_no", "bits", "block").orderBy(F.col("h") < 0, "h", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    leaf = leaf.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return leaf.join(above, ["source_no", "bits", "block"]).withColumn("before", F.col("before") + F.col("base")).drop("base", "block")


def mix(docs: DataFrame, plan=schedules, max_epochs: float = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """One row for each row of docs (doc_id, text, source), in order of training.

    Returns doc_id, size, source_size, target, taken, copies, position (of the
    first copy; null if the mix takes none) and positions (of every copy).

    A source's documents are all taken floor(target / source_size) times. The
    rest of the target is met in a hashed order by large documents, those of more
    than a LARGE-th of the target, in proportion to their part of the source, and then
    by the others, which fill what the large ones leave. So what is taken differs from the target by at most
    half a document of a LARGE-th of it, unless large ones are all that is left; then one more of these comes as near as it can. Null
    texts and blank ones have size 0: they are taken as often as a document at
    their place. A null source is a source of its own, after all others.
    Repeated rows are taken like different documents. An empty table gives an
    empty result, a source of blank documents a target of 0. Other columns are ignored.
    """
    slim = cut(sizes(docs))
    return place(slim, plan, max_epochs, seed)


def _shares(at: DataFrame, max_epochs: float, few) -> DataFrame:
    """Add full (epochs), rest (words of the target beyond them), small (words of documents that aren't large), take (words of
    large ones for the rest) and copies to a written table of _offsets()."""
    epochs = F.least(F.floor(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)) + 1e-12), F.lit(int(max_epochs))).cast("int")
    at = at.withColumn("full", epochs).withColumn("rest", F.greatest(F.col("target") - F.col("full") * F.col("source_size"), F.lit(0.0)))
    large = F.col("h") < 0
    small = at.groupBy("source_no").agg(F.coalesce(F.sum(F.when(~large, F.col("size"))), F.lit(0)).alias("small"))
    end, share = F.col("before") - F.col("small") + F.col("size"), F.col("rest") * F.try_divide(F.col("source_size") - F.col("small"), F.col("source_size"))
    at = at.join(few(small), "source_no")
    # Large documents up to their share, or one more, whichever lets the others meet the target better.
    ends = at.where(large).groupBy("source_no", "rest", "small").agg(F.coalesce(F.max(F.when(end <= share, end)), F.lit(0)).alias("a"), F.min(F.when(end > share, end)).alias("b"))
    miss = lambda x: F.greatest(x - F.col("rest"), F.col("rest") - x - F.col("small"), F.lit(0.0))
    take = ends.select("source_no", F.when(miss(F.col("b")) < miss(F.col("a")), F.col("b")).otherwise(F.col("a")).alias("take"))
    at = at.join(few(take), "source_no", "left").withColumn("take", F.coalesce("take", F.lit(0)))
    # Where all others are taken and words are still lacking, the large document that comes nearest to what is lacking.
    lacking = F.col("rest") - F.col("take") - F.col("small")
    nearest = at.where(large & (end > F.col("take")) & (F.abs(F.col("size") - lacking) < lacking)).groupBy("source_no").agg(F.min(F.struct(F.abs(F.col("size") - lacking), "before")).alias("n"))
    at = at.join(few(nearest.select("source_no", F.col("n.before").alias("fill"))), "source_no", "left")
    more = F.when(large, (end <= F.col("take")) | F.coalesce(F.col("before") == F.col("fill"), F.lit(False))).otherwise(F.col("before") + F.col("size") / 2 <= F.col("rest") - F.col("take"))
    more = more & (F.col("full") < max_epochs) & (F.col("source_size") > 0)
    return at.withColumn("copies", F.col("full") + more.cast("int")).drop("fill")


def place(slim: DataFrame, plan=schedules, max_epochs: float = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """mix() of a materialised table of sizes(), with what else it has."""
    stats = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    wanted = targets(stats, plan(stats.select("source")), max_epochs)
    wanted = cut(wanted.withColumn("source_no", F.xxhash64(F.col("source"), F.col("source").isNull())).withColumn(
        "bits", F.greatest(F.lit(0), F.ceil(F.log2(F.col("rows") / BLOCK_ROWS)).cast("int"))
    ))
    most, sources = wanted.agg(F.coalesce(F.max("bits"), F.lit(0)), F.count("*")).first()
    few = F.broadcast if sources <= FEW_SOURCES else lambda x: x
    named = few(wanted.withColumnRenamed("source", "_source"))
    rows = slim.join(named, slim["source"].eqNullSafe(named["_source"])).drop("_source", "source", "knots", "rows")
    large = F.col("size") * LARGE > F.col("target")
    # Unsigned, the hashes of large documents follow all others.
    h = F.shiftrightunsigned(F.xxhash64("doc_id", "size", "text_hash", F.lit(seed)), 1).bitwiseOR(F.when(large, F.lit(-(2**63))).otherwise(F.lit(0)))
    at = cut(_offsets(rows.withColumn("h", h).drop("text_hash"), most))
    at = _shares(at, max_epochs, few)
    # The part of its stretch (an epoch, or the rest) at which a document of its class is needed: both classes are spread over it.
    behind = F.col("before") + F.col("size") / 2 - F.when(F.col("h") < 0, F.col("small")).otherwise(F.lit(0))
    part = lambda of_large, of_small: F.least(F.coalesce(F.try_divide(behind, F.when(F.col("h") < 0, of_large).otherwise(of_small)), F.lit(1.0)), F.lit(1.0))
    middle = lambda k: F.when(k < F.col("full"), (k + part(F.col("source_size") - F.col("small"), F.col("small"))) * F.col("source_size")).otherwise(
        F.col("full") * F.col("source_size") + part(F.col("take"), F.col("rest") - F.col("take")) * F.col("rest")
    )
    place_of = lambda k: _inverse(F.col("segments"), F.coalesce(F.try_divide(middle(k), F.col("target")), F.lit(0.0)) * F.col("weight"))
    at = at.withColumn("positions", F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), place_of)).otherwise(F.array().cast("array<double>")))
    at = at.withColumn("taken", F.col("size") * F.col("copies")).withColumn("position", F.get("positions", F.lit(0)))
    # Documents that aren't taken follow the others, spread by their hash, so that no range holds them all.
    at = at.withColumn("place", F.coalesce("position", 3 + F.col("h") / F.lit(2.0**63)))
    at = at.drop("segments", "weight", "source_no", "bits", "full", "before", "small", "rest", "take")
    return at.repartitionByRange("place", "h").sortWithinPartitions("place", "h").drop("place", "h")


def sequence(docs: DataFrame, plan=schedules, max_epochs: float = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """The rows of docs with all columns, each as often as mix() takes it, in order of training.

    A row is known by its doc_id, its source and a hash of its text, so rows
    that repeat all three share what is taken of them all. Documents without a
    word, null texts among them, are taken like others; a null source is a source
    of its own. An empty table gives an empty result. Columns may have any names.
    """
    row = F.struct(*[docs[c] for c in docs.columns])
    keyed = lambda d: F.concat_ws("|", F.coalesce(d["doc_id"].cast("string"), F.lit("")), F.xxhash64(d["doc_id"], d["source"], d["text"]))
    slim = cut(sizes(docs.select(keyed(docs).alias("key"), "doc_id", "source", "text"), "key"))
    placed = place(slim, plan, max_epochs, seed).where("copies > 0").select("key", F.explode("positions").alias("place"))
    # Rows of one key are alike: each takes as many of its places as there are rows, in turn.
    shares = placed.groupBy("key").agg(F.sort_array(F.collect_list("place")).alias("places"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("row.text"))
    rows = docs.select(keyed(docs).alias("key"), row.alias("row")).join(shares, "key").select("row", "places", "key", nth.alias("nth"))
    of = slim.groupBy("key").agg(F.count("*").alias("of")).where("of > 1")
    rows = rows.join(of, "key", "left")
    mine = F.filter("places", lambda p, i: F.pmod(i, F.coalesce("of", F.lit(1))) == F.col("nth") - 1)
    out = rows.select("row", F.explode(mine).alias("place"))
    return out.repartitionByRange("place").sortWithinPartitions("place").select("row.*")
