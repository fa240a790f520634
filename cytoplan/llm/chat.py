"""Multi-party chat rendering: each participant's view of a dialogue.

For every participant of a conversation (each role but ``system``) the dialogue is rendered with that speaker as the assistant, the
others as named users and system turns as such; the mask lists the character spans that the speaker wrote, with their end marks.
A dialogue comes in chunks of ``CHUNK`` turns, in order, so that no conversation, however long, is gathered in one row; places in
the mask count from the chunk's beginning, which is given by its place in the whole view. :func:`whole_views` joins the chunks.

Turns are ranked by (turn, role, text): a range partitioning over all of these splits a long conversation, rows are numbered in
each part, and the parts' counts are added up before them.

Edge cases: a null role is the participant ``unknown``, with any of that name; a null text is empty; ``<|`` in a text is written ``<\\|``,
so that it cannot pass for a mark; null turns come first; repeated rows are repeated
turns; a null conv_id is a conversation of its own; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

CHUNK, SALT = 256, 8
END = "<|end|>\n"


def ranked(df: DataFrame, group: str, *order: str) -> DataFrame:
    """``df`` with ``rank`` from 0 in each group, by ``order``; a group may be spread over many tasks."""
    n = C.parallelism(df.sparkSession)
    parts = C.materialise(df.repartitionByRange(n, group, *order).withColumn("part", F.spark_partition_id()), "ranked")
    counts = parts.groupBy(group, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(group).alias("g"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("part", group).orderBy(*order)
    rows = parts.withColumn("own", F.row_number().over(own) - 1)
    return rows.join(counts, F.col(group).eqNullSafe(F.col("g")) & (F.col("part") == F.col("p"))).withColumn("rank", F.col("own") + F.col("before")).drop("g", "p", "part", "own", "before")


def perspectives(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, speaker, chunk, start, n_turns, text and mask (start:end, comma-joined) of each participant's view.

    ``start`` is the chunk's place in the whole view, in characters; mask spans count from it.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("<\\|")).alias("text"))
    turns = ranked(rows, "conv_id", "turn", "role", "text").withColumn("chunk", F.floor(F.col("rank") / chunk)).withColumn("salt", F.floor(F.col("chunk") / SALT))
    # A long conversation's speakers are repeated for each SALT chunks of it, so its turns meet them in many tasks.
    longest = turns.groupBy(F.col("conv_id").alias("k")).agg(F.max("salt").alias("last"))
    speakers = rows.where("role <> 'system'").select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct()
    speakers = speakers.join(longest, F.col("c").eqNullSafe(F.col("k"))).select("c", "speaker", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("s"))
    mine = F.col("role") == F.col("speaker")
    head = F.when(mine, F.lit("<|assistant|>\n")).when(F.col("role") == "system", F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), F.col("role"), F.lit("|>\n")))
    w = Window.partitionBy("conv_id", "speaker", "chunk").orderBy("rank")
    seen = (
        turns.join(speakers, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("salt") == F.col("s")))
        .select("conv_id", "speaker", "chunk", "rank", mine.alias("mine"), F.length(head).alias("head"), F.concat(head, F.col("text"), F.lit(END)).alias("part"))
        .withColumn("end", F.sum(F.length("part")).over(w))
        .withColumn("span", F.when(F.col("mine"), F.concat_ws(":", (F.col("end") - F.length("part") + F.col("head")).cast("string"), F.col("end").cast("string"))))
    )
    out = seen.groupBy("conv_id", "speaker", "chunk").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("rank", "part", "span"))).alias("t"))
    out = C.materialise(out.select("conv_id", "speaker", "chunk", "n_turns", F.array_join(F.col("t.part"), "").alias("text"), F.array_join(F.col("t.span"), ",").alias("mask")), "chat-views")
    before = Window.partitionBy("k", "p").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    starts = out.select(F.col("conv_id").alias("k"), F.col("speaker").alias("p"), F.col("chunk").alias("n"), F.length("text").alias("size"))
    starts = starts.select("k", "p", "n", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("start"))
    joined = out.join(starts, F.col("conv_id").eqNullSafe(F.col("k")) & (F.col("speaker") == F.col("p")) & (F.col("chunk") == F.col("n")))
    return joined.select("conv_id", "speaker", "chunk", "start", "n_turns", "text", "mask")


def whole_views(views: DataFrame) -> DataFrame:
    """conv_id, speaker, n_turns, text and mask (in the whole text) of each view in one row; a view must fit in a task's memory."""
    parts = views.groupBy("conv_id", "speaker").agg(F.sum("n_turns").alias("n_turns"), F.array_sort(F.collect_list(F.struct("chunk", "start", "text", "mask"))).alias("t"))
    moved = F.transform("t", lambda x: F.array_join(F.transform(F.filter(F.split(x["mask"], ","), lambda m: m != ""), lambda m: F.array_join(F.transform(F.split(m, ":"), lambda n: (n.cast("long") + x["start"]).cast("string")), ":")), ","))
    return parts.select("conv_id", "speaker", "n_turns", F.array_join(F.col("t.text"), "").alias("text"), F.array_join(F.filter(moved, lambda m: m != ""), ",").alias("mask"))


PERSPECTIVES_SQL = f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '<\\|') AS text FROM conversations),
turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS rank FROM rows),
speakers AS (SELECT DISTINCT conv_id AS c, role AS speaker FROM rows WHERE role <> 'system'),
seen AS (SELECT conv_id, speaker, rank // {CHUNK} AS chunk, rank, role = speaker AS mine,
    CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' ELSE '<|user name=' || role || '|>' END || chr(10) AS head, text || '<|end|>' || chr(10) AS body
  FROM turns JOIN speakers ON conv_id IS NOT DISTINCT FROM c),
placed AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, chunk ORDER BY rank ROWS UNBOUNDED PRECEDING) AS stop FROM seen)
SELECT conv_id, speaker, CAST(chunk AS BIGINT) AS chunk, CAST(coalesce(sum(sum(length(head) + length(body))) OVER (PARTITION BY conv_id, speaker ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
  count(*) AS n_turns, string_agg(head || body, '' ORDER BY rank) AS text,
  coalesce(string_agg(CASE WHEN mine THEN CAST(stop - length(body) AS BIGINT) || ':' || CAST(stop AS BIGINT) END, ',' ORDER BY rank), '') AS mask
FROM placed GROUP BY conv_id, speaker, chunk
"""
