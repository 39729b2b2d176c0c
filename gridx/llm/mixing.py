"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Every source gets a target number of words: a share of the budget by weight, at most `epochs` times what the source
has, the excess reshared by weight. A source's documents are shuffled by the hash of their id and follow one another
`epochs` times. A document is served in pieces of at most PIECE words; a piece's virtual finish time is the source's
words up to its end, over all passes, divided by the source's target. The pieces of all sources compete: they are
range-sorted by finish time and cut where their words reach the total budget, the piece in service in part. Nothing
else bounds what a source gives, so a source is off its target by a piece or two at most.

Running sums never gather a source or a range in one task: the shuffle order and the finish times are cut into
ranges, sums run inside a range, and two levels of range totals give the offsets. Of the sorted pieces only the
range in which the budget ends is put in order; what lies before its cut is a comparison in every row.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents of size 0
have no part in the order and take 0; rows without an id are shuffled by their text; repeated rows are documents of
their own; an empty table gives an empty result; extra columns are ignored unless carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridx.llm.common import broadcast_within, cut

WEIGHTS = (3, 1, 2)
SHARE, EPOCHS = 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
#: Words that are served at a time.
PIECE = 128
#: Rows that one range of the shuffle order or of the finish time is sized for, and ranges under one total.
RANGE_ROWS, RANGES = 2048, 1024


def sizes(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, source, size (words), order (the place in the source's shuffle) and the carried columns."""
    text, doc_id = docs["text"].cast("string"), docs["doc_id"].cast("long")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    order = F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("")))
    kept = [docs[c].alias(f"carried_{i}") for i, c in enumerate(carry)]
    return docs.select(doc_id.alias("doc_id"), docs["source"].cast("string").alias("source"), size.alias("size"), order.alias("order"), *kept)


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """sid, source, source_size, target: the level `share` * total is poured over the sources by weight, each filled
    at most to epochs * source_size. Works on one row per source."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    by = by.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    by = by.withColumn("weight", F.get(turn, F.pmod("sid", F.lit(len(weights)))))
    by = by.withColumn("cap", F.lit(float(epochs)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    by = by.withColumn("level", left / weight_left)
    by = by.withColumn("full", F.col("ratio") <= F.col("level"))
    by = by.withColumn("poured", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("poured") * F.col("weight"))
    return by.select("sid", "source", "source_size", "source_rows", target.alias("target"))


def words_before(totals: DataFrame, by: list[str], place: str) -> DataFrame:
    """by, place and `ahead`: the words at smaller places of the same `by`, from (by, place, words).

    Sums run among RANGES neighbouring places, then among their totals.
    """
    wide = totals.withColumn("block", F.floor(F.col(place) / RANGES))
    earlier = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = wide.groupBy(*by, "block").agg(F.sum("words").alias("words"))
    start = F.coalesce(F.sum("words").over(earlier(by, "block")), F.lit(0))
    blocks = blocks.select(*[F.col(c).alias(f"of_{c}") for c in by], F.col("block").alias("of_block"), start.alias("start"))
    inside = F.coalesce(F.sum("words").over(earlier([*by, "block"], place)), F.lit(0))
    same = F.col("block") == F.col("of_block")
    for c in by:
        same = same & (F.col(c) == F.col(f"of_{c}"))
    return wide.withColumn("inside", inside).join(blocks, same).select(*by, place, "words", (F.col("start") + F.col("inside")).alias("ahead"))


def schedule(sized: DataFrame, narrow: DataFrame, by_source: DataFrame) -> DataFrame:
    """Every row of sized with sid, bucket, nth (its place in the bucket) and before: the words of its source that
    are served ahead of it in a pass. narrow has the same rows and is read for totals. One shuffle of sized."""
    counted = by_source.agg(F.count("*").alias("n"), F.sum("source_rows").alias("rows")).first()
    ranges = max(64, -(-(counted["rows"] or 0) // RANGE_ROWS))
    names = broadcast_within(by_source.drop("source_rows"), counted["n"]).withColumnRenamed("source", "source_name")
    bucket = F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * ranges / F.lit(float(1 << 32)))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(names, F.col("source").eqNullSafe(F.col("source_name"))).drop("source_name").withColumn("bucket", bucket)

    totals = placed(narrow).groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    offsets = cut(words_before(totals, ["sid"], "bucket").select("sid", "bucket", "ahead"))
    inside = Window.partitionBy("sid", "bucket").orderBy("order", "doc_id", "size")
    running = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = placed(sized).withColumn("nth", F.row_number().over(inside)).withColumn("running", running)
    return rows.join(broadcast_within(offsets, offsets.count()), ["sid", "bucket"]).withColumn("before", F.col("ahead") + F.col("running")).drop("ahead", "running")


def finish_of(words: Column) -> Column:
    """Virtual time at which so many words of a source have been served."""
    return words / F.col("target")


def pieces(scheduled: DataFrame, epochs: int) -> DataFrame:
    """One row per pass and piece of each document: sid, bucket, nth, pass, piece, words and finish."""
    turn = scheduled.where("size > 0").select("sid", "bucket", "nth", "size", "source_size", "target", "before", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("pass"))
    each = turn.withColumn("piece", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("size") / PIECE))))
    end = F.least("size", F.col("piece") * PIECE)
    words = end - (F.col("piece") - 1) * PIECE
    return each.select("sid", "bucket", "nth", "pass", "piece", words.alias("words"), finish_of(F.col("before") + F.col("pass") * F.col("source_size") + end).alias("finish"))


KEY = ["finish", "sid", "bucket", "nth", "pass", "piece"]


def budget_end(served: DataFrame, budget: int, rows: int) -> dict | None:
    """The piece in service where the sorted pieces' words reach the budget, and the words it gives; None if they never do.

    Ranges of finish time are summed, the first range that reaches the budget is found, and that range alone is sorted.
    """
    ranges = max(64, -(-rows // RANGE_ROWS))
    ranged = served.withColumn("range", F.floor(F.col("finish") / (1 + F.col("finish")) * ranges))
    sums = words_before(ranged.groupBy("range").agg(F.sum("words").alias("words")), [], "range")
    last = sums.where(F.col("ahead") + F.col("words") >= budget).orderBy("range").limit(1).first()
    if last is None:
        return None
    order = Window.orderBy(*KEY).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.where(F.col("range") == last["range"]).withColumn("ahead", F.lit(last["ahead"]) + F.coalesce(F.sum("words").over(order), F.lit(0)))
    end = inside.where(F.col("ahead") + F.col("words") >= budget).orderBy(*KEY).first().asDict()
    return {k: end[k] for k in KEY} | {"words": budget - end["ahead"], "piece_words": end["words"]}


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document and pass: sid, bucket, nth, pass, size, source_size, target, finish (of its last word)
    and words: what the mix takes of it before its budget ends. Carried columns are carried_0, carried_1, ..."""
    narrow = cut(sizes(docs))
    by_source = cut(targets(narrow, weights, share, epochs))
    total = by_source.agg(F.sum("source_size").alias("words"), F.sum("source_rows").alias("rows")).first()
    words, rows = total["words"] or 0, total["rows"] or 0
    scheduled = schedule(narrow, narrow, by_source)
    if carry:
        plain, scheduled = scheduled, schedule(sizes(docs, *carry), narrow, by_source)
    else:
        plain = scheduled = cut(scheduled)
    end = budget_end(pieces(plain, epochs), int(min(share, epochs) * words), epochs * (rows + words // PIECE)) if words else None
    turn = scheduled.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    begin = F.col("before") + F.col("pass") * F.col("source_size")
    taken = F.col("size")
    if end is not None:
        # whole pieces before the end, which are the first ones of the document, and the part of the piece in service
        here = (F.col("sid") == end["sid"]) & (F.col("bucket") == end["bucket"]) & (F.col("nth") == end["nth"]) & (F.col("pass") == end["pass"])
        own = F.struct("sid", "bucket", "nth", F.col("pass").cast("int"))
        other = F.struct(F.lit(end["sid"]).cast("int"), F.lit(end["bucket"]).cast("long"), F.lit(end["nth"]).cast("int"), F.lit(end["pass"]).cast("int"))
        ends = F.transform(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("size") / PIECE)), lambda k: F.least(F.col("size"), k * PIECE))
        before = F.filter(ends, lambda e: (finish_of(begin + e) < end["finish"]) | ((finish_of(begin + e) == end["finish"]) & (own < other)))
        whole = F.coalesce(F.array_max(before), F.lit(0))
        partly = F.when(F.col("size") == 0, 0).when(finish_of(begin + F.col("size")) < end["finish"], F.col("size")).when(finish_of(begin) > end["finish"], 0)
        taken = F.when(here, (end["piece"] - 1) * PIECE + end["words"]).otherwise(F.coalesce(partly, whole))
    finish = F.when(F.col("target") > 0, finish_of(begin + F.col("size")))
    names = ["doc_id", "source", "sid", "bucket", "nth", "size", "source_size", "target", "pass", *[f"carried_{i}" for i in range(len(carry))]]
    return turn.select(*names, finish.alias("finish"), taken.cast("long").alias("words"))


def taken_words(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words over all its passes)."""
    key = ["sid", "bucket", "nth", "doc_id", "source", "size", "source_size", "target"]
    return mix(docs, weights, share, epochs).groupBy(*key).agg(F.sum("words").alias("taken")).drop("sid", "bucket", "nth")


def mixed_rows(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """The documents of the mix with all their columns, range-sorted by finish time, once for each pass of which the
    mix takes at least half before its budget ends. A document without words is kept once."""
    carry = docs.columns
    chosen = mix(docs, weights, share, epochs, tuple(carry)).where(((F.col("size") > 0) & (2 * F.col("words") >= F.col("size"))) | ((F.col("size") == 0) & (F.col("pass") == 0)))
    ordered = chosen.orderBy("finish", "sid", "bucket", "nth", "pass")
    return ordered.select(*[F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)])


SQL = """
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS place,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM sized GROUP BY source
), weighted AS (
  SELECT *, CAST([3, 1, 2][1 + sid % 3] AS DOUBLE) AS weight, CAST(2.0 AS DOUBLE) * source_size AS cap FROM by_source
), leveled AS (
  SELECT *, cap / weight AS ratio,
    (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0)) AS level
  FROM weighted WINDOW w AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), poured AS (
  SELECT *, max(CASE WHEN ratio > level THEN level END) OVER () AS height FROM leveled
), targets AS (
  SELECT source, sid, source_size, CASE WHEN ratio <= level THEN cap ELSE height * weight END AS target FROM poured
), scheduled AS (
  SELECT d.doc_id, d.size, t.sid, t.source_size, t.target, row_number() OVER w AS nth,
    CAST(coalesce(sum(d.size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source WINDOW w AS (PARTITION BY t.sid ORDER BY d.place, d.doc_id, d.size)
), turns AS (
  SELECT *, unnest([0, 1]) AS pass FROM scheduled WHERE size > 0
), pieces AS (
  SELECT *, unnest(range(1, 1 + CAST(ceil(size / 128) AS BIGINT))) AS piece FROM turns
), ended AS (
  SELECT *, least(size, piece * 128) - (piece - 1) * 128 AS words, (before + pass * source_size + least(size, piece * 128)) / target AS finish FROM pieces
), placed AS (
  SELECT *, coalesce(sum(words) OVER (ORDER BY finish, sid, nth, pass, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM ended
), taken AS (
  SELECT sid, nth, CAST(sum(least(words, greatest(0, (SELECT CAST(floor(1.5 * sum(size)) AS BIGINT) FROM sized) - ahead))) AS BIGINT) AS taken FROM placed GROUP BY sid, nth
)
SELECT s.doc_id, s.size, s.source_size, s.target, coalesce(t.taken, 0) AS taken FROM scheduled s LEFT JOIN taken t USING (sid, nth)
"""
