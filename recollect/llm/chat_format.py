"""Preference formatting of pairs of conversations, in DataFrame functions.

Two conversations, one chosen and one rejected, share their longest common prefix of turns (same role and
text). The prefix is rendered once as the prompt; what is left of each is its completion, with a mask of
the character spans to learn from: the texts of assistant turns and the marks that end them.

A turn is rendered as <|role|>, a line break, the text, <|end|> and a line break. A <| within a role or
text is written <\\|, so that no text can pose as a mark.

Defined cases: a null role is the role "none", a null text is empty. Turns are in the order of turn, nulls
first, then role and text; repeated rows are turns of their own. A pair that lacks one side has that
side's completion and mask empty and an empty prompt; identical sides have empty completions. A pair whose
key is null is left out. Of other columns nothing is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEARNED_ROLE, END = "assistant", "<|end|>\n"
_BODY = "concat('<|', t.role, '|>\\n', t.text, '<|end|>\\n')"


def _rendered(turns: str) -> str:
    return f"array_join(transform({turns}, t -> {_BODY}), '')"


def _mask(turns: str) -> str:
    """start:end of the learned parts of the rendered turns, in characters."""
    step = (
        f"aggregate({turns}, named_struct('at', 0, 'spans', cast(array() as array<string>)), (a, t) -> named_struct("
        f"'at', a.at + length({_BODY}), "
        "'spans', if(t.role = 'assistant', array_append(a.spans, concat(a.at + length(t.role) + 5, ':', a.at + length(t.role) + 5 + length(t.text) + 7)), a.spans))).spans"
    )
    return f"array_join({step}, ',')"


def formatted_preferences(turns: DataFrame, pair: str = "pair_id", chosen: str = "is_chosen") -> DataFrame:
    """From turns (pair, chosen, turn, role, text): one row for each pair: pair_id, n_prefix, prompt, chosen,
    rejected, chosen_mask, rejected_mask."""
    clean = lambda c, none: F.replace(F.coalesce(F.col(c), F.lit(none)), F.lit("<|"), F.lit("<\\|"))
    rows = turns.where(F.col(pair).isNotNull()).select(
        F.col(pair).alias("pair_id"), F.col(chosen).alias("side"), F.struct("turn", clean("role", "none").alias("role"), clean("text", "").alias("text")).alias("t")
    )
    sides = rows.groupBy("pair_id").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("t")))).alias(name) for s, name in ((True, "c"), (False, "r"))]
    )
    plain = sides.select("pair_id", *[F.expr(f"transform({x}, t -> named_struct('role', t.role, 'text', t.text))").alias(x) for x in "cr"])
    n = "aggregate(sequence(1, greatest(1, least(size(c), size(r)))), 0, (n, i) -> if(n = i - 1 and size(c) >= i and size(r) >= i and c[i - 1] = r[i - 1], i, n))"
    cut = plain.withColumn("n_prefix", F.expr(n))
    rest = {x: f"slice({x}, n_prefix + 1, size({x}))" for x in "cr"}
    return cut.select(
        "pair_id", "n_prefix", F.expr(_rendered("slice(c, 1, n_prefix)")).alias("prompt"),
        F.expr(_rendered(rest["c"])).alias("chosen"), F.expr(_rendered(rest["r"])).alias("rejected"),
        F.expr(_mask(rest["c"])).alias("chosen_mask"), F.expr(_mask(rest["r"])).alias("rejected_mask"),
    )


def preference_digests(conversations: DataFrame) -> DataFrame:
    """Conversation 2k is the chosen side and 2k + 1 the rejected side of pair k; texts come as SHA-256."""
    turns = conversations.withColumns({"pair_id": F.floor(F.col("conv_id") / 2).cast("long"), "is_chosen": F.col("conv_id") % 2 == 0})
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return formatted_preferences(turns).select("pair_id", "n_prefix", sha("prompt"), sha("chosen"), sha("rejected"), "chosen_mask", "rejected_mask")


#: The same in DuckDB.
SQL = """
    WITH t AS (
        SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS is_chosen, conv_id,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, replace(coalesce(role, 'none'), '<|', '<\\|'), replace(coalesce(text, ''), '<|', '<\\|')) AS i,
               replace(coalesce(role, 'none'), '<|', '<\\|') AS role, replace(coalesce(text, ''), '<|', '<\\|') AS text
        FROM conversations WHERE conv_id IS NOT NULL),
    p AS (SELECT DISTINCT pair_id FROM t),
    same AS (SELECT c.pair_id, c.i FROM t c JOIN t r ON c.pair_id = r.pair_id AND c.i = r.i AND c.is_chosen AND NOT r.is_chosen AND c.role = r.role AND c.text = r.text),
    run AS (SELECT pair_id, i, row_number() OVER (PARTITION BY pair_id ORDER BY i) AS k FROM same),
    prefix AS (SELECT p.pair_id, count(run.i) FILTER (WHERE run.i = run.k) AS n_prefix FROM p LEFT JOIN run USING (pair_id) GROUP BY p.pair_id),
    body AS (
        SELECT t.*, n_prefix, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS body FROM t JOIN prefix USING (pair_id)),
    placed AS (
        SELECT *, coalesce(sum(length(body)) OVER (PARTITION BY conv_id, i > n_prefix ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM body)
    SELECT pair_id, any_value(n_prefix)::INT AS n_prefix,
           sha256(coalesce(string_agg(body, '' ORDER BY i) FILTER (WHERE is_chosen AND i <= n_prefix), '')) AS prompt_sha256,
           sha256(coalesce(string_agg(body, '' ORDER BY i) FILTER (WHERE is_chosen AND i > n_prefix), '')) AS chosen_sha256,
           sha256(coalesce(string_agg(body, '' ORDER BY i) FILTER (WHERE NOT is_chosen AND i > n_prefix), '')) AS rejected_sha256,
           coalesce(string_agg((pos + length(role) + 5)::VARCHAR || ':' || (pos + length(role) + 5 + length(text) + 7)::VARCHAR, ',' ORDER BY i) FILTER (WHERE is_chosen AND i > n_prefix AND role = 'assistant'), '') AS chosen_mask,
           coalesce(string_agg((pos + length(role) + 5)::VARCHAR || ':' || (pos + length(role) + 5 + length(text) + 7)::VARCHAR, ',' ORDER BY i) FILTER (WHERE NOT is_chosen AND i > n_prefix AND role = 'assistant'), '') AS rejected_mask
    FROM placed GROUP BY pair_id
"""
