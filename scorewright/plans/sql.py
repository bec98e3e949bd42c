"""Fragments shared by the checking SQL."""

from __future__ import annotations

from scorewright.functions.text import WHITESPACE_POINTS

_SPACES = "||".join(f"chr({point})" for point in WHITESPACE_POINTS)


def strip(text: str) -> str:
    return f"trim({text}, {_SPACES})"


def words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def sentences(text: str) -> str:
    marked = rf"regexp_replace({text}, '([.!?])[\t\n\x0b\f\r ]+', '\1' || chr(1), 'g')"
    parts = f"list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')})"
    return f"list_filter({parts}, lambda s: s <> '')"


def ratio(numerator: str, denominator: str, places: int) -> str:
    """numerator / denominator of non-negative integers, rounded half-up in integer arithmetic."""
    scale = 10**places
    return (
        f"(CASE WHEN ({denominator}) <> 0 THEN CAST((2 * {scale} * CAST({numerator} AS HUGEINT) + ({denominator}))"
        f" // (2 * ({denominator})) AS DOUBLE) / {scale}.0 END)"
    )


def kb(text: str) -> str:
    return ratio(f"strlen({text})", "1024", 3)


def micro_dollars(tokens: str, model: str) -> str:
    """Cost in millionths of a dollar: 0.33 or 5.5 per token, rounded half-up."""
    return (
        f"(CASE {model} WHEN 'gpt-4o-mini' THEN (({tokens}) * 33 + 50) // 100"
        f" WHEN 'gpt-4o' THEN (({tokens}) * 55 + 5) // 10 ELSE 0 END)"
    )


PAIRS = """
pairs AS (
  SELECT u.conv_id, u.turn, u.text AS question, a.text AS reply
  FROM (SELECT * FROM conversations WHERE role = 'user') u
  LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1)
"""


def packed(source: str, keys: str, order: str, size: str, most: int) -> str:
    """Rows of ``source`` with ``part``: where the running size passes a multiple of ``most``, a part ends."""
    return f"""
    (SELECT *, (2 * ((upto - bytes) // {most}) + CASE WHEN upto > ((upto - bytes) // {most} + 1) * {most} THEN 1 ELSE 0 END)::BIGINT AS part
     FROM (SELECT *, (sum(bytes) OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
           FROM (SELECT *, strlen({size}) AS bytes FROM {source})))
    """


def f1(name: str, source: str, answer: str, reference: str) -> str:
    """CTE with ``conv_id, turn, overlap, size`` of the word multisets of two columns."""
    return f"""
{name}_a AS (
  SELECT conv_id, turn, w, count(*) AS n FROM (
    SELECT conv_id, turn, unnest({words(answer)}) AS w FROM {source}) GROUP BY ALL),
{name}_r AS (
  SELECT conv_id, turn, w, count(*) AS n FROM (
    SELECT conv_id, turn, unnest({words(reference)}) AS w FROM {source}) GROUP BY ALL),
{name} AS (
  SELECT s.conv_id, s.turn,
    CASE WHEN s.{answer} IS NOT NULL THEN coalesce((SELECT sum(least(a.n, r.n)) FROM {name}_a a JOIN {name}_r r USING (conv_id, turn, w)
       WHERE a.conv_id = s.conv_id AND a.turn = s.turn), 0) END AS overlap,
    CASE WHEN s.{answer} IS NOT NULL THEN len({words('s.' + answer)}) + coalesce(len({words('s.' + reference)}), 0) END AS size
  FROM {source} s)
"""


def f1_score(alias: str) -> str:
    return (
        f"(CASE WHEN {alias}.size IS NULL THEN NULL WHEN {alias}.size = 0 THEN 0.0 ELSE "
        + ratio(f"2 * {alias}.overlap", f"{alias}.size", 3)
        + " END)"
    )


def f1_raw(alias: str) -> str:
    return (
        f"(CASE WHEN {alias}.size IS NULL THEN NULL WHEN {alias}.size = 0 THEN 0.0"
        f" ELSE CAST(2 * {alias}.overlap AS DOUBLE) / {alias}.size END)"
    )
