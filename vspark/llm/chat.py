"""Operator 3: preference formatting of conversations (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
#: Only what these roles say is learned from.
TRAINED = "assistant"


def _render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit(CLOSE), F.coalesce(turn["text"], F.lit("")), F.lit(END))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _mask(turns: Column) -> Column:
    """start:end of each stretch of the rendered turns that is learned from, in code points, end exclusive: an assistant's text and its end mark."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        head = F.length(F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit(CLOSE)))
        end = acc["at"] + F.length(_render(turn))
        span = F.concat_ws(":", (acc["at"] + head).cast("string"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(turn["role"] == TRAINED, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: F.array_join(acc["spans"], ","))


def format_preferences(turns: DataFrame) -> DataFrame:
    """One row a pair: the longest common turn prefix rendered once as prompt, and what follows on either side as masked completions.

    turns: pair_id, chosen (boolean: which side), conv_id, turn, role, text. A side's turns go by turn, then role, then text;
    turns are common while role and text are equal on both sides. Returns pair_id, chosen_id, rejected_id, n_prefix,
    prompt, chosen, rejected, chosen_mask, rejected_mask, complete.

    Null role or text: rendered as empty, equal to null only. Equal conversations: all of it is prompt, completions are empty.
    A pair without one side: n_prefix 0, that side's id, completion and mask null, complete false. Null pair_id: not paired, left out.
    Repeated turns: each is a turn. Empty tables: no rows. Other columns are not read. One shuffle, by pair; a task holds one pair's two
    conversations, which end up as one row, however often a conversation is repeated under other ids.
    """
    turn = F.struct("turn", "role", "text")
    side = lambda which: F.array_sort(F.collect_list(F.when(F.col("chosen") == which, turn)))
    rows = turns.filter("pair_id is not null").groupBy("pair_id").agg(
        side(True).alias("c"), side(False).alias("r"),
        F.min(F.when(F.col("chosen"), F.col("conv_id"))).alias("chosen_id"), F.min(F.when(~F.col("chosen"), F.col("conv_id"))).alias("rejected_id"),
    )
    both = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", 1, both), F.slice("r", 1, both), lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    differs = F.array_position(same, F.lit(False))
    rows = rows.withColumn("n_prefix", F.when(differs > 0, differs - 1).otherwise(both).cast("long"))
    after = lambda a: F.slice(a, (F.col("n_prefix") + 1).cast("int"), F.greatest(F.size(a), F.lit(1)))
    there = lambda a, value: F.when(F.size(a) > 0, value)
    return rows.select(
        "pair_id", "chosen_id", "rejected_id", "n_prefix", _joined(F.slice("c", 1, F.col("n_prefix").cast("int"))).alias("prompt"),
        there("c", _joined(after("c"))).alias("chosen"), there("r", _joined(after("r"))).alias("rejected"),
        there("c", _mask(after("c"))).alias("chosen_mask"), there("r", _mask(after("r"))).alias("rejected_mask"),
        ((F.size("c") > 0) & (F.size("r") > 0)).alias("complete"),
    )


def op3_preferences(spark, sf_dir: str) -> DataFrame:
    """Conversations 2n (chosen) and 2n + 1 (rejected) are pair n."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    pair, chosen = F.floor(F.col("conv_id") / 2).alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("chosen")
    return format_preferences(turns.select(pair, chosen, "conv_id", "turn", "role", "text"))


SQL = f"""
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, conv_id, role, text,
         '{OPEN}' || coalesce(role, '') || '|>' || chr(10) AS head,
         coalesce(text, '') || '<|end|>' || chr(10) AS tail,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (
  SELECT pair_id, min(conv_id) FILTER (side = 0) AS chosen_id, min(conv_id) FILTER (side = 1) AS rejected_id,
         least(count(*) FILTER (side = 0), count(*) FILTER (side = 1)) AS shorter
  FROM t GROUP BY pair_id),
differing AS (
  SELECT c.pair_id, min(c.pos) AS pos FROM t c JOIN t r ON c.pair_id = r.pair_id AND c.pos = r.pos AND c.side = 0 AND r.side = 1
  WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text GROUP BY c.pair_id),
prefix AS (
  SELECT s.*, CAST(coalesce(d.pos - 1, s.shorter) AS BIGINT) AS n_prefix FROM sizes s LEFT JOIN differing d USING (pair_id)),
placed AS (
  SELECT t.*, n_prefix, pos > n_prefix AS after,
         sum(length(head) + length(tail)) OVER (PARTITION BY conv_id, pos > n_prefix ORDER BY pos) AS ends
  FROM t JOIN prefix USING (pair_id)),
sides AS (
  SELECT pair_id, side, coalesce(string_agg(head || tail, '' ORDER BY pos) FILTER (NOT after), '') AS prompt,
         coalesce(string_agg(head || tail, '' ORDER BY pos) FILTER (after), '') AS completion,
         coalesce(string_agg((ends - length(tail))::VARCHAR || ':' || ends::VARCHAR, ',' ORDER BY pos) FILTER (after AND role = '{TRAINED}'), '') AS mask
  FROM placed GROUP BY pair_id, side)
SELECT p.pair_id, p.chosen_id, p.rejected_id, p.n_prefix, coalesce(c.prompt, '') AS prompt, c.completion AS chosen, r.completion AS rejected,
       c.mask AS chosen_mask, r.mask AS rejected_mask, c.pair_id IS NOT NULL AND r.pair_id IS NOT NULL AS complete
FROM prefix p LEFT JOIN sides c ON p.pair_id = c.pair_id AND c.side = 0 LEFT JOIN sides r ON p.pair_id = r.pair_id AND r.side = 1
"""
