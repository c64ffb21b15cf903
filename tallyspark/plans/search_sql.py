"""DuckDB SQL that routes cycles: greedy, the milestone seed, and the hill climb, one trial a round.

A cycle is a list of spends with what each of the four cards would pay for it; an assignment is a list
of cards. Valuing one is a fold over both, whose accumulator holds what the capped buckets took.
"""

from __future__ import annotations

GOAL, GRANT, PASSES = 8_000_000, 150_000, 8

_EMPTY = "{'online': CAST(0 AS BIGINT), 'offline': CAST(0 AS BIGINT), 'fast': CAST(0 AS BIGINT), 'paid': CAST(0 AS BIGINT), 'spent': CAST(0 AS BIGINT)}"
_A = "greatest(0, least({s}.sbi, 200000 - CASE WHEN {s}.online THEN acc.online ELSE acc.offline END))"
_F = "greatest(0, least({s}.axis_capped, 50000 - acc.fast))"


def _taken(card: str, s: str) -> str:
    """The accumulator after one spend on a card."""
    a, f = _A.format(s=s), _F.format(s=s)
    return f"""{{'online': acc.online + CASE WHEN {card} = 0 AND {s}.online THEN {a} ELSE 0 END, 'offline': acc.offline + CASE WHEN {card} = 0 AND NOT {s}.online THEN {a} ELSE 0 END, 'fast': acc.fast + CASE WHEN {card} = 1 THEN {f} ELSE 0 END,
      'paid': acc.paid + CASE {card} WHEN 0 THEN {a} WHEN 1 THEN CASE WHEN {f} > 0 THEN {f} ELSE {s}.axis_base END WHEN 2 THEN {s}.icici ELSE {s}.goal END, 'spent': acc.spent + CASE WHEN {card} = 3 THEN {s}.amount ELSE 0 END}}"""


def _value(own: str) -> str:
    """Rewards and the grant of an assignment of the list ``spends``."""
    # the fold runs over places, as DuckDB's reduce wants elements of the accumulator's type no longer
    fold = f"list_reduce(list_prepend({_EMPTY}, list_transform(range(1, len(spends) + 1), lambda p: {{'online': p, 'offline': CAST(0 AS BIGINT), 'fast': CAST(0 AS BIGINT), 'paid': CAST(0 AS BIGINT), 'spent': CAST(0 AS BIGINT)}})), lambda acc, x: {_taken(f'{own}[x.online]', 'spends[x.online]')})"
    return f"list_transform([{fold}], lambda r: r.paid + CASE WHEN r.spent >= {GOAL} THEN {GRANT} ELSE 0 END)[1]"


def routed(gross: str) -> str:
    """CTEs after ``gross(scale, cycle_id, spend_seq, amount_paise, channel, sbi, axis_capped, axis_base, icici)``,
    to follow WITH RECURSIVE; the last, routed, has a row a cycle and scale."""
    offers = "[greatest(0, least(g.sbi, 200000 - CASE g.channel WHEN 'online' THEN t.online ELSE t.offline END)), CASE WHEN least(g.axis_capped, 50000 - t.fast) > 0 THEN least(g.axis_capped, 50000 - t.fast) ELSE g.axis_base END, g.icici, g.goal]"
    return f"""
    h AS (SELECT *, CAST(round(CAST(amount_paise AS DOUBLE) * CAST(0.01 AS DOUBLE)) AS BIGINT) AS goal FROM {gross}),
    t(scale, cycle_id, j, online, offline, fast, own) AS (
      SELECT DISTINCT scale, cycle_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM h
      UNION ALL
      SELECT scale, cycle_id, j + 1, online + CASE WHEN card = 0 AND channel = 'online' THEN offers[1] ELSE 0 END, offline + CASE WHEN card = 0 AND channel <> 'online' THEN offers[1] ELSE 0 END, fast + CASE WHEN card = 1 THEN greatest(0, room) ELSE 0 END, list_append(own, card)
      FROM (SELECT *, list_position(offers, list_max(offers)) - 1 AS card FROM (SELECT t.*, g.channel, least(g.axis_capped, 50000 - t.fast) AS room, {offers} AS offers FROM t JOIN h g ON g.scale = t.scale AND g.cycle_id = t.cycle_id AND g.spend_seq = t.j + 1))),
    lists AS (SELECT scale, cycle_id, list({{'amount': amount_paise, 'online': channel = 'online', 'sbi': sbi, 'axis_capped': axis_capped, 'axis_base': axis_base, 'icici': icici, 'goal': goal}} ORDER BY spend_seq) AS spends FROM h GROUP BY ALL),
    greedy AS (SELECT l.scale, l.cycle_id, spends, own FROM lists l JOIN t ON t.scale = l.scale AND t.cycle_id = l.cycle_id AND t.j = len(spends)),
    losses AS (SELECT scale, cycle_id, spend_seq, amount_paise, greatest(0, least(sbi, 200000), CASE WHEN least(axis_capped, 50000) > 0 THEN least(axis_capped, 50000) ELSE axis_base END, icici) - goal AS loss FROM h),
    moved AS (SELECT scale, cycle_id, spend_seq, coalesce(sum(amount_paise) OVER (PARTITION BY scale, cycle_id ORDER BY loss, -amount_paise, spend_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {GOAL} AS moves FROM losses),
    seeds AS (SELECT g.scale, g.cycle_id, g.spends, list(CASE WHEN moves THEN 3 ELSE g.own[spend_seq] END ORDER BY spend_seq) AS own FROM greedy g JOIN moved m ON m.scale = g.scale AND m.cycle_id = g.cycle_id GROUP BY ALL),
    starts AS (SELECT *, {_value('own')} AS total FROM (SELECT 0 AS start, * FROM greedy UNION ALL SELECT 1, * FROM seeds)),
    climb(scale, cycle_id, start, own, total, turn, pass, better) AS (
      SELECT scale, cycle_id, start, own, total, CAST(0 AS BIGINT), 1, false FROM starts
      UNION ALL
      SELECT scale, cycle_id, start, CASE WHEN wins THEN tried ELSE own END, CASE WHEN wins THEN value ELSE total END, CASE WHEN ends THEN 0 ELSE turn + 1 END, CASE WHEN ends THEN CASE WHEN better OR wins THEN pass + 1 ELSE {PASSES} + 1 END ELSE pass END, NOT ends AND (better OR wins)
      FROM (SELECT *, value > total AS wins, turn + 1 = 4 * len(own) AS ends FROM (SELECT *, CASE WHEN tried = own THEN total ELSE {_value('tried')} END AS value
        FROM (SELECT c.*, s.spends, list_transform(own, lambda card, p: CASE WHEN p = turn // 4 + 1 THEN turn % 4 ELSE card END) AS tried FROM climb c JOIN lists s ON s.scale = c.scale AND s.cycle_id = c.cycle_id WHERE pass <= {PASSES})))),
    ended AS (SELECT scale, cycle_id, max(total) AS allocated FROM climb GROUP BY ALL),
    routed AS (SELECT g.scale, g.cycle_id, CAST(len(g.spends) AS BIGINT) AS n_spends, CAST(list_sum(list_transform(g.spends, lambda s: s.amount)) AS BIGINT) AS spend_paise, s.total AS greedy_paise, e.allocated AS allocated_paise
      FROM greedy g JOIN starts s ON s.scale = g.scale AND s.cycle_id = g.cycle_id AND s.start = 0 JOIN ended e ON e.scale = g.scale AND e.cycle_id = g.cycle_id)"""


REPORT = """CAST(count(*) AS BIGINT) AS cycles, CAST(sum(n_spends) AS BIGINT) AS spends, CAST(sum(spend_paise) AS BIGINT) AS spend_paise, CAST(sum(greedy_paise) AS BIGINT) AS greedy_paise, CAST(sum(allocated_paise) AS BIGINT) AS allocated_paise,
  CAST(sum(allocated_paise) - sum(greedy_paise) AS BIGINT) AS missed_paise, round(CASE WHEN sum(allocated_paise) <= 0 THEN CAST(0 AS DOUBLE) ELSE CAST(sum(allocated_paise) - sum(greedy_paise) AS DOUBLE) / CAST(sum(allocated_paise) AS DOUBLE) END, 6) AS leakage,
  CAST(sum(spend_paise) // count(*) AS BIGINT) AS monthly_spend_paise"""
