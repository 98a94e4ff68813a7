"""Chat formatting of preference pairs: a shared prompt and two completions with loss masks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def preference_pairs(turns: DataFrame, pair: str = "pair_id", side: str = "side", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """Render pairs of conversations for preference training.

    ``turns`` has one row a turn: the pair's id, the side (``chosen`` or ``rejected``; others are left out), the turn's
    number, role and text. Turns are ordered by number, then role and text; null roles and texts count as empty. The
    longest common prefix of equal turns (role and text) is rendered once as ``prompt``; what follows on each side is
    ``chosen`` and ``rejected``, each turn as ``<|role|>\\ntext<|end|>\\n``. ``chosen_mask`` and ``rejected_mask`` list the
    character ranges (start:end, end exclusive, by the completion) that the loss covers: text and end mark of the
    trained role's turns. A missing side gives empty strings; a null pair id is a pair of its own. The only group that
    is gathered is one pair's turns. Returns ``pair_id``, ``n_prompt_turns``, ``n_chosen_turns``, ``n_rejected_turns``
    (whole conversations) and the strings.
    """
    rows = turns.where(F.col(side).isin("chosen", "rejected")).select(
        F.col(pair).alias("pair_id"), F.col(side).alias("side"), F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("t")
    )
    side_turns = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("t"))))
    pairs = rows.groupBy("pair_id").agg(side_turns("chosen").alias("c"), side_turns("rejected").alias("r"))
    differ = F.filter(
        F.sequence(F.lit(0), F.least(F.size("c"), F.size("r"))),
        lambda i: (i >= F.least(F.size("c"), F.size("r"))) | (F.get("c", i)["role"] != F.get("r", i)["role"]) | (F.get("c", i)["text"] != F.get("r", i)["text"]),
    )
    pairs = pairs.withColumn("n", F.get(differ, F.lit(0)))
    shown = lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))
    render = lambda turns: F.array_join(F.transform(turns, shown), "")
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))

    def mask(turns):
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
        head = lambda t: F.length(t["role"]) + 5

        def step(s, t):
            span = F.concat_ws(":", (s["at"] + head(t)).cast("string"), (s["at"] + F.length(shown(t)) - 1).cast("string"))
            return F.struct((s["at"] + F.length(shown(t))).alias("at"), F.when(t["role"] == trained, F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

        return F.aggregate(turns, start, step, lambda s: F.array_join(s["spans"], ","))

    return pairs.select(
        "pair_id", F.col("n").alias("n_prompt_turns"), F.size("c").alias("n_chosen_turns"), F.size("r").alias("n_rejected_turns"),
        render(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"), render(rest("c")).alias("chosen"), render(rest("r")).alias("rejected"),
        mask(rest("c")).alias("chosen_mask"), mask(rest("r")).alias("rejected_mask"),
    )


def with_other_answers(conversations: DataFrame, trained: str = "assistant") -> DataFrame:
    """A pair of sides for every conversation: itself as chosen, and with another's last answer as rejected.

    The other conversation is the one whose id differs in the last bit. Its last turn of the ``trained`` role (by
    number, then text) takes the place of this one's; if it has none, or there is no such conversation, this one's is
    left out. So the two sides share all turns before. Rows that repeat the last answer are replaced alike; a
    conversation without answers is the same on both sides; null ids are one conversation without another. Returns
    ``pair_id`` (the conversation's id), ``side``, ``turn``, ``role`` and ``text``; other columns are left out.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    place = F.struct(F.coalesce("turn", F.lit(-1)).alias("turn"), F.coalesce("text", F.lit("")).alias("text"))
    last = rows.where(F.col("role") == trained).groupBy("pair_id").agg(F.max(place).alias("last"))
    own = last.select(F.col("pair_id").alias("own_id"), F.col("last").alias("own"))
    other = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("other_id"), F.col("last.text").alias("other"))
    both = rows.join(own, F.col("pair_id").eqNullSafe(F.col("own_id")), "left").join(other, F.col("pair_id") == F.col("other_id"), "left")
    answer = (F.col("role") == trained) & (place == F.col("own"))
    rejected = both.withColumn("answer", F.coalesce(answer, F.lit(False))).where("not answer or other is not null")
    rejected = rejected.withColumn("text", F.when(F.col("answer"), F.col("other")).otherwise(F.col("text")))
    named = lambda df, s: df.select("pair_id", F.lit(s).alias("side"), "turn", "role", "text")
    return named(rows, "chosen").unionByName(named(rejected, "rejected"))


PAIRS_SQL = """
WITH base AS (SELECT conv_id AS pair_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
last AS (SELECT pair_id, max({'turn': turn, 'text': text}) AS own FROM base WHERE role = 'assistant' GROUP BY 1),
sides AS (
  SELECT pair_id, 0 AS side, turn, role, text FROM base UNION ALL
  SELECT b.pair_id, 1, b.turn, b.role, CASE WHEN b.role = 'assistant' AND {'turn': b.turn, 'text': b.text} = l.own THEN o.own['text'] ELSE b.text END
  FROM base b LEFT JOIN last l ON b.pair_id IS NOT DISTINCT FROM l.pair_id LEFT JOIN last o ON xor(o.pair_id, 1) = b.pair_id
  WHERE o.own IS NOT NULL OR NOT (b.role = 'assistant' AND coalesce({'turn': b.turn, 'text': b.text} = l.own, false))),
t AS (SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS i FROM sides),
n AS (SELECT pair_id, count(*) FILTER (side = 0) AS nc, count(*) FILTER (side = 1) AS nr FROM t GROUP BY 1),
d AS (SELECT c.pair_id, min(c.i) AS i FROM t c JOIN t r ON c.pair_id IS NOT DISTINCT FROM r.pair_id AND c.side = 0 AND r.side = 1 AND c.i = r.i WHERE c.role <> r.role OR c.text <> r.text GROUP BY 1),
p AS (SELECT n.*, coalesce(d.i - 1, least(nc, nr)) AS k FROM n LEFT JOIN d ON n.pair_id IS NOT DISTINCT FROM d.pair_id),
x AS (SELECT t.*, p.k, p.nc, p.nr, sum(length(shown)) OVER (PARTITION BY t.pair_id, side, t.i > p.k ORDER BY t.i) - length(shown) AS head FROM t JOIN p ON t.pair_id IS NOT DISTINCT FROM p.pair_id)
SELECT pair_id, any_value(k)::INT AS n_prompt_turns, any_value(nc)::INT AS n_chosen_turns, any_value(nr)::INT AS n_rejected_turns,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 0 AND i <= k), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 0 AND i > k), '') AS chosen,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 1 AND i > k), '') AS rejected,
  coalesce(string_agg((head + length(role) + 5)::BIGINT || ':' || (head + length(shown) - 1)::BIGINT, ',' ORDER BY i) FILTER (side = 0 AND i > k AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((head + length(role) + 5)::BIGINT || ':' || (head + length(shown) - 1)::BIGINT, ',' ORDER BY i) FILTER (side = 1 AND i > k AND role = 'assistant'), '') AS rejected_mask
FROM x GROUP BY pair_id"""
