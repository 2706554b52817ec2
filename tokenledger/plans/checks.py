"""SQL of the checking engine for the ledger's queries, written from the rules and not from the Spark code.

Prices are joined by substring and ranked here, suggestions are unrolled step
by step, pairs of prompts are all compared, hard budgets are folded by
recursion, tools are scored one by one.
"""

from __future__ import annotations

from tokenledger import settings as S
from tokenledger.adapters import MODEL, ORDER_MODEL
from tokenledger.plans.queries import ASSUMED, BLOCKING, CAPPED, COACH, COMPACT, QUERIES
from tokenledger.settings import DEFAULTS as D

UNITS = 10_000_000


def _values(rows: list[tuple], names: str) -> str:
    show = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS v({names})"


def hint(hints: tuple, name: str) -> str:
    return "(" + " OR ".join(f"contains(lower({name}), '{h.lower()}')" for h in hints) + ")"


def word(text: str, words: str) -> str:
    return rf"regexp_matches({text}, '(?i)\b(?:{words})\b')"


def usd(x: str) -> str:
    return f"cast({x} AS double) / 1e13"


TOTALS = f"count(*) AS turns, cast(sum(input_tokens) AS bigint) AS input_tokens, cast(sum(output_tokens) AS bigint) AS output_tokens, {usd('sum(cast(cost_units AS hugeint))')} AS cost"
WORDS = "list_sort(list_distinct(list_filter(string_split_regex(regexp_replace({0}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > {1})))"
SPACES = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
JACCARD = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0e0 ELSE len(list_intersect({0}, {1})) / cast(len({0}) + len({1}) - len(list_intersect({0}, {1})) AS double) END"


def _turns(period: str) -> str:
    return f"""SELECT CASE WHEN event_id % 4 = 0 THEN 'agent' ELSE 'legacy' END AS source, 'p' || (user_id % 9) AS project, 's' || user_id || '-' || ({period}) AS session_id, event_id AS seq,
      CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 20 = 19 THEN 'r' || (event_id - 1) ELSE 'r' || event_id END AS response_id, {MODEL} AS model, CASE WHEN event_id % 97 <> 0 THEN ts END AS ts,
      cast(floor(value * 100) AS bigint) AS input_tokens, 20 * cast(json_extract_string(props, '$.k') AS bigint) AS output_tokens, CASE WHEN event_id % 4 = 0 THEN cast(floor(value * 60) AS bigint) END AS cache_read_tokens,
      'ask ' || (event_id % 50) AS snippet, 'f' || (event_id % 7) || '.py' AS file FROM events"""


_DEDUP = """SELECT * EXCLUDE (n) FROM (SELECT *, CASE WHEN response_id = '' THEN 1 ELSE row_number() OVER (PARTITION BY response_id ORDER BY source <> 'legacy', project, session_id, seq) END AS n FROM {0}) WHERE n = 1"""
_PRICED = f"""SELECT t.*, cast(ts AS date) AS day, b.price_key, b.p_in, b.p_out, greatest(0, least(cache_read_tokens, input_tokens)) AS cached_tokens, output_tokens * p_out AS output_units,
  CASE WHEN cache_read_tokens IS NULL THEN input_tokens * p_in ELSE (input_tokens - greatest(0, least(cache_read_tokens, input_tokens))) * p_in + cast(floor(greatest(0, least(cache_read_tokens, input_tokens)) * p_in * {D.cache_read_multiplier}e0 + 0.5) AS bigint) END AS input_units,
  output_units + input_units AS cost_units FROM {{0}} t JOIN book_of b ON t.model = b.model"""


def suggestions(asked: str = "asked") -> str:
    """The book gone through key by key, a step a subquery, for what was asked (model, tin, tout, now)."""
    sql = f"SELECT *, now AS best, cast(NULL AS varchar) AS pick FROM {asked}"
    for _, key, a, b in D.prices():
        cost = f"(tin * {round(a * UNITS)} + tout * {round(b * UNITS)})"
        better = f"NOT contains(lower(model), '{key}') AND {cost} < best * 0.999e0"
        sql = f"SELECT model, tin, tout, now, CASE WHEN {better} THEN {cost} ELSE best END AS best, CASE WHEN {better} THEN '{key}' ELSE pick END AS pick FROM ({sql})"
    return f"SELECT model, tin, tout, now, best, pick FROM ({sql}) WHERE pick IS NOT NULL AND now > 0 AND (now - best) / cast(now AS double) >= {D.suggestion_floor}e0"


_ASKED = "SELECT DISTINCT x.model, tin, tout, tin * p_in + tout * p_out AS now FROM (SELECT model, input_tokens AS tin, output_tokens AS tout FROM turns UNION SELECT model, context_tokens, projected FROM prompts_projected) x JOIN book_of b ON x.model = b.model"
PROJECT = "cast(ceil(least(2000.0e0, ceil(0.3e0 * {0})) * {1}) AS bigint)"
REASON = f"CASE WHEN {hint(D.reasoning_hints, '{0}')} THEN {D.reasoning_multiplier}e0 ELSE 1.0e0 END"
_LEAD = "CASE (conv_id + turn) % 6 WHEN 0 THEN 'Write a function: ' WHEN 1 THEN 'List the files: ' WHEN 2 THEN 'Debug the race condition: ' WHEN 3 THEN 'Explain, be concise: ' WHEN 4 THEN '/src/app/main.py ' ELSE 'Contact a.b@example.com: ' END"
CHEAPEST = min(((k, round(a * UNITS), round(b * UNITS)) for _, k, a, b in D.prices()), key=lambda r: r[1] + r[2])
WANTED = "model IN ('claude-opus-4.8', 'gpt-4o-mini', 'gemini-3-flash') AND project IN ('p1', 'p2', 'p3', 'p4', 'p5')"
_HISTORY = f"regexp_replace(regexp_replace(lower(prompt), '(?s)```.*?```', ' ', 'g'), '{SPACES}+', ' ', 'g')"

#: name -> (the names that it reads, SQL).
PARTS: dict[str, tuple[str, str]] = {
    "turns": ("", _turns("year(ts) * 10000 + month(ts) * 100 + day(ts)")),
    "turns_monthly": ("", _turns("year(ts) * 100 + month(ts)")),
    "book": ("", "SELECT ordinal, price_key, cast(p_in AS bigint) AS p_in, cast(p_out AS bigint) AS p_out FROM (" + _values([(i, k, round(a * UNITS), round(b * UNITS)) for i, k, a, b in D.prices()], "ordinal, price_key, p_in, p_out") + ")"),
    "credit_book": ("", _values([tuple(x) for x in D.credits()], "ordinal, credit_key, multiplier")),
    "prompts": ("", f"""WITH said AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS chars FROM conversations),
      base AS (SELECT conv_id, turn, {_LEAD} || CASE WHEN conv_id % 8 = 3 THEN text || ' ' || text || ' ' || text || ' ' ELSE text END AS prompt, cast(ceil(chars / 4) AS bigint) AS context_tokens FROM said WHERE role = 'user'),
      every AS (SELECT * FROM base UNION ALL SELECT conv_id, turn + 100, prompt || ' please', context_tokens FROM base WHERE turn <= 1 AND conv_id % 5 = 0 UNION ALL SELECT conv_id + 1000000, turn, prompt || ' again', context_tokens FROM base WHERE turn <= 1 AND conv_id % 7 = 0)
      SELECT conv_id AS session_id, turn AS seq, prompt, context_tokens, (conv_id * 7 + turn) % 9 AS ref_count, conv_id * 1000 + turn AS asked_at, 'w' || (conv_id % 7) AS project, (conv_id + turn) % 23 = 0 AS whole,
        CASE conv_id % 6 WHEN 0 THEN 'claude-opus-4.8' WHEN 1 THEN 'gpt-4o-mini' WHEN 2 THEN 'claude-3-5-sonnet' WHEN 3 THEN 'gemini-1.5-pro' WHEN 4 THEN 'o3' ELSE 'in-house-7b' END AS model FROM every"""),
    "prompts_projected": ("prompts", f"SELECT *, {PROJECT.format('context_tokens', REASON.format('model'))} AS projected FROM prompts"),
    "request_models": ("", f"SELECT * FROM (SELECT 'q' || o_orderkey AS request_id, {ORDER_MODEL} AS model FROM orders) WHERE model <> ''"),
    "models": ("turns prompts request_models", "SELECT DISTINCT model FROM turns UNION SELECT model FROM prompts UNION SELECT 'Copilot/' || upper(model) FROM request_models"),
    "book_of": ("models book", f"""SELECT model, price_key, coalesce(p_in, {round(D.fallback[0] * UNITS)}) AS p_in, coalesce(p_out, {round(D.fallback[1] * UNITS)}) AS p_out FROM (
      SELECT m.model, b.*, row_number() OVER (PARTITION BY m.model ORDER BY length(b.price_key) DESC, b.ordinal) AS n FROM models m LEFT JOIN book b ON contains(lower(m.model), b.price_key)) WHERE n = 1"""),
    "deduped": ("turns", _DEDUP.format("turns")), "deduped_monthly": ("turns_monthly", _DEDUP.format("turns_monthly")),
    "priced": ("deduped book_of", _PRICED.format("deduped")), "priced_monthly": ("deduped_monthly book_of", _PRICED.format("deduped_monthly")),
    "cells": ("priced", "SELECT day, model, project, count(*) AS turns, cast(sum(input_tokens) AS bigint) AS input_tokens, cast(sum(output_tokens) AS bigint) AS output_tokens, sum(cast(input_units AS hugeint)) AS input_units, sum(cast(output_units AS hugeint)) AS output_units, sum(cast(cost_units AS hugeint)) AS cost_units FROM priced GROUP BY ALL"),
    "filtered": ("cells", f"SELECT * FROM cells WHERE {WANTED}"),
    "by_model": ("cells", "SELECT model, sum(turns) AS turns, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens, sum(input_units) AS input_units, sum(output_units) AS output_units, sum(cost_units) AS cost_units FROM cells GROUP BY model"),
    "daily": ("cells", "SELECT day, sum(cost_units) AS cost_units FROM cells WHERE day IS NOT NULL GROUP BY day"),
    "sessions": ("priced turns", """SELECT p.project, p.session_id, count(*) AS turns, cast(sum(p.input_tokens) AS bigint) AS input_tokens, cast(sum(p.output_tokens) AS bigint) AS output_tokens, sum(cast(cost_units AS hugeint)) AS cost_units,
      arg_min(day, p.seq) FILTER (day IS NOT NULL) AS first_day, any_value(CASE WHEN f.latest % 3 = 0 THEN 'Title ' || f.latest ELSE f.snippet END) AS title
      FROM priced p JOIN (SELECT project, session_id, arg_min(snippet, seq) AS snippet, max(seq) AS latest FROM turns GROUP BY ALL) f ON p.project = f.project AND p.session_id = f.session_id GROUP BY p.project, p.session_id"""),
    "detail": ("priced", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, session_id ORDER BY seq) AS place FROM priced) WHERE place <= 200"),
    "usage_log": ("priced_monthly", f"""SELECT session_id, seq, model, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS turn_index, {hint(D.reasoning_hints, 'model')} AS reasoning, seq % 13 = 0 AS duplicate,
      CASE WHEN seq % 13 = 0 THEN 0 ELSE input_tokens END AS input_tokens, CASE WHEN seq % 13 = 0 THEN 0 ELSE output_tokens END AS output_tokens, CASE WHEN seq % 13 = 0 THEN 0 ELSE cost_units END AS cost_units FROM priced_monthly"""),
    "calibrated": ("usage_log", f"SELECT model, count(*) AS turns, avg(input_tokens) AS avg_input, avg(output_tokens) AS avg_output, {usd('sum(cast(cost_units AS hugeint))')} / count(*) AS avg_cost, sum(output_tokens) / nullif(cast(sum(input_tokens) AS double), 0) AS out_in_ratio, bool_or(reasoning) AS reasoning, min(seq) AS ordinal FROM usage_log GROUP BY model"),
    "baseline": ("usage_log", "SELECT sum(output_tokens) FILTER (NOT reasoning) / nullif(cast(sum(input_tokens) FILTER (NOT reasoning) AS double), 0) AS baseline FROM usage_log"),
    "growth": ("usage_log", "SELECT session_id, seq, turn_index, growth FROM (SELECT *, input_tokens - lag(input_tokens) OVER (PARTITION BY session_id ORDER BY turn_index) AS growth FROM usage_log) WHERE growth IS NOT NULL"),
    "p90": ("growth", "SELECT count(*) AS growths, list_sort(list(growth))[least(count(*), (9 * count(*)) // 10 + 1)] AS p90 FROM growth WHERE growth > 0"),
    "multipliers": ("models calibrated baseline", f"""SELECT model, CASE WHEN turns >= {D.min_turns} AND out_in_ratio > 0 AND baseline > 0 THEN greatest(1.0e0, least(5.0e0, floor(out_in_ratio / baseline * 100 + 0.5) / 100)) END AS multiplier FROM (
      SELECT m.model, c.turns, c.out_in_ratio, row_number() OVER (PARTITION BY m.model ORDER BY c.turns DESC, lower(c.model)) AS n FROM (SELECT model FROM turns UNION SELECT 'v/' || model FROM turns UNION SELECT left(model, 2) FROM turns) m LEFT JOIN calibrated c ON contains(lower(m.model), lower(c.model)) OR contains(lower(c.model), lower(m.model))), baseline WHERE n = 1"""),
    "asked": ("turns prompts_projected book_of", _ASKED),
    "suggested": ("asked", suggestions()),
    "spent": ("turns_monthly", f"SELECT *, coalesce(cast(cast(ts AS date) AS varchar), '') AS d, input_tokens + {PROJECT.format('input_tokens', REASON.format('model'))} AS projected, input_tokens + cast(ceil(output_tokens * {REASON.format('model')}) AS bigint) AS spent FROM turns_monthly"),
    "session_sets": ("prompts", f"SELECT session_id, seq, {WORDS.format('lower(prompt)', 1)} AS words FROM prompts"),
    "session_best": ("session_sets", f"SELECT * FROM (SELECT a.session_id, a.seq, max({JACCARD.format('a.words', 'b.words')}) AS similarity FROM session_sets a JOIN session_sets b ON a.session_id = b.session_id AND b.seq < a.seq GROUP BY ALL) WHERE similarity >= {D.dup_threshold}"),
    "norms": ("prompts", f"SELECT session_id, seq, asked_at, project, left(trim({_HISTORY}), 500) AS norm, {WORDS.format(f'left(trim({_HISTORY}), 500)', 2)} AS words FROM prompts"),
    "history": ("norms", "SELECT norm, any_value(words) AS words, min(asked_at) AS first, max(asked_at) AS latest, arg_max(project, asked_at) AS project FROM norms WHERE len(words) >= 4 GROUP BY norm"),
    "history_best": ("norms history", f"""SELECT session_id, seq, norm, similarity, latest, project FROM (SELECT *, row_number() OVER (PARTITION BY session_id, seq ORDER BY similarity DESC, latest DESC, norm DESC) AS n FROM (
      SELECT a.session_id, a.seq, h.norm, h.latest, h.project, {JACCARD.format('a.words', 'h.words')} AS similarity FROM norms a JOIN history h ON h.first < a.asked_at AND len(a.words) >= 4) WHERE similarity >= {D.history_threshold}) WHERE n = 1"""),
    "flags": ("prompts_projected session_best history_best suggested book_of", f"""SELECT p.*, sd.similarity IS NOT NULL AS duplicate, sd.similarity IS NULL AND hd.norm IS NOT NULL AS asked_before, whole AS whole_workspace, NOT whole AND ref_count > {D.max_refs} AS many_references,
      coalesce(context_tokens - last_value(CASE WHEN sd.similarity IS NULL THEN context_tokens END IGNORE NULLS) OVER (PARTITION BY p.session_id ORDER BY p.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {COACH.snowball_tokens}, false) AS snowball,
      regexp_matches(prompt, '{COACH.sensitive_patterns[0]}') AS sensitive,
      regexp_matches(t, '^(```|[A-Za-z]:\\\\|/)') OR (length(t) > 600 AND NOT regexp_matches(t, '(?i)^(?:{S.STABLE_LEAD})')) AS cache_order,
      NOT {hint(D.cheap_hints, 'p.model')} AND ({word('prompt', S.TRIVIAL)} OR NOT {word('prompt', S.HARD)}) AND length(prompt) < 600 AND g.pick IS NOT NULL AS overkill,
      {word('prompt', S.GENERATIVE)} AND NOT ({word('prompt', S.BRIEF)} OR regexp_matches(prompt, '(?i)[A-Za-z0-9_]<{SPACES}*[0-9]+{SPACES}*(words|lines|tokens)\\b')) AND length(prompt) < 2000 AS no_cap, {hint(D.reasoning_hints, 'p.model')} AS reasoning, b.price_key IS NULL AS unknown_price
      FROM (SELECT *, regexp_replace(prompt, '^{SPACES}+', '') AS t FROM prompts_projected) p LEFT JOIN session_best sd ON p.session_id = sd.session_id AND p.seq = sd.seq LEFT JOIN history_best hd ON p.session_id = hd.session_id AND p.seq = hd.seq
      LEFT JOIN suggested g ON g.model = p.model AND g.tin = p.context_tokens AND g.tout = p.projected JOIN book_of b ON b.model = p.model"""),
    "edit_ops": ("", "SELECT 'e' || (l_orderkey % 50) AS session_id, l_linenumber = 1 AND l_returnflag = 'R' AS made, l_partkey % 5 <> 0 AS there, CASE WHEN l_partkey % 11 = 0 THEN '/ws/other' ELSE '/ws/app/src' END || '/f' || (l_partkey * 100 + l_suppkey % 10) || '.py' AS fs_path, CASE WHEN l_orderkey % 13 = 0 THEN '' ELSE 'q' || l_orderkey END AS request_id FROM lineitem"),
    "files": ("edit_ops request_models", """SELECT *, CASE WHEN NOT there AND created THEN 'discarded' WHEN iterations >= 3 THEN 'rework' WHEN there THEN 'kept' ELSE 'pending' END AS verdict FROM (
      SELECT fs_path, count(*) AS ops, greatest(1, count(DISTINCT nullif(e.request_id, ''))) AS iterations, bool_or(made) AS created, bool_or(there) AS there, coalesce(list_sort(list(DISTINCT model) FILTER (model IS NOT NULL)), []) AS models
      FROM edit_ops e LEFT JOIN request_models m ON e.request_id = m.request_id WHERE starts_with(fs_path, '/ws/app/') GROUP BY fs_path)"""),
    "messages": ("", "SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'tool_result' ELSE 'text' END AS kind, text FROM conversations"),
    "compacted": ("messages", f"""SELECT conv_id, turn, CASE WHEN cut THEN left(text, 400) || chr(10) || '…[compacted: ' || format('{{:,}}', length(text) - 400) || ' characters left out]' ELSE text END AS text, CASE WHEN cut THEN length(text) - 400 ELSE 0 END AS chars_saved FROM (
      SELECT *, kind = 'tool_result' AND length(text) > 500 AND chars > {COMPACT.max_context_tokens * 4} AND from_end > 2 AS cut FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id) AS chars, row_number() OVER (PARTITION BY conv_id, kind ORDER BY turn DESC) AS from_end FROM messages))"""),
}

_SHOWN = f"cast(day AS varchar) AS day, model, project, turns, input_tokens, output_tokens, {usd('input_units')} AS input_cost, {usd('output_units')} AS output_cost, {usd('cost_units')} AS cost"
_SESSIONS = f"project, session_id, turns, input_tokens, output_tokens, {usd('cost_units')} AS cost, cast(first_day AS varchar) AS first_day, title"
_COUNTS = ", ".join(f"count(*) FILTER (verdict = '{v}') AS {v}" for v in ("kept", "rework", "discarded", "pending"))
_RATIO = "CASE WHEN {1} = 0 THEN 0.0e0 ELSE ({0}) / cast({1} AS double) END"
_LEARNT = lambda m: f"CASE WHEN {hint(D.reasoning_hints, m)} THEN coalesce(multiplier, {D.reasoning_multiplier}e0) ELSE 1.0e0 END"
#: The same parts, with what a log shows in the place of the settings.
PARTS |= {
    "prompt_log": ("prompts", f"SELECT session_id, seq, model, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS turn_index, context_tokens AS input_tokens, context_tokens * (session_id % 3 + 1) AS output_tokens, {hint(D.reasoning_hints, 'model')} AS reasoning FROM prompts"),
    "prompt_models": ("prompt_log", "SELECT model, count(*) AS turns, sum(output_tokens) / nullif(cast(sum(input_tokens) AS double), 0) AS out_in_ratio FROM prompt_log GROUP BY model"),
    "prompt_multipliers": ("prompt_models", f"""SELECT model, CASE WHEN turns >= {D.min_turns} AND out_in_ratio > 0 AND baseline > 0 THEN greatest(1.0e0, least(5.0e0, floor(out_in_ratio / baseline * 100 + 0.5) / 100)) END AS multiplier FROM (
      SELECT m.model, c.turns, c.out_in_ratio, row_number() OVER (PARTITION BY m.model ORDER BY c.turns DESC, lower(c.model)) AS n FROM prompt_models m JOIN prompt_models c ON contains(lower(m.model), lower(c.model)) OR contains(lower(c.model), lower(m.model))), (SELECT sum(output_tokens) / cast(sum(input_tokens) AS double) AS baseline FROM prompt_log WHERE NOT reasoning) WHERE n = 1"""),
    "prompt_p90": ("prompt_log", f"SELECT CASE WHEN count(*) >= {D.min_turns} THEN coalesce(list_sort(list(g) FILTER (g > 0))[least(count(*) FILTER (g > 0), (9 * (count(*) FILTER (g > 0))) // 10 + 1)], {COACH.snowball_tokens}) ELSE {COACH.snowball_tokens} END AS threshold FROM (SELECT input_tokens - lag(input_tokens) OVER (PARTITION BY session_id ORDER BY seq) AS g FROM prompt_log)"),
    "prompts_learnt": ("prompts prompt_multipliers", f"SELECT prompts.*, {PROJECT.format('context_tokens', _LEARNT('prompts.model'))} AS projected FROM prompts JOIN prompt_multipliers USING (model)"),
    "asked_learnt": ("turns prompts_learnt book_of", _ASKED.replace("prompts_projected", "prompts_learnt")), "suggested_learnt": ("asked_learnt", suggestions("asked_learnt")),
    "flags_learnt": ("prompts_learnt session_best history_best suggested_learnt book_of prompt_p90", PARTS["flags"][1].replace("prompts_projected", "prompts_learnt").replace("LEFT JOIN suggested g", "LEFT JOIN suggested_learnt g").replace(f"> {COACH.snowball_tokens}, false", "> (SELECT threshold FROM prompt_p90), false")),
    "spent_learnt": ("turns_monthly multipliers", f"SELECT t.*, coalesce(cast(cast(ts AS date) AS varchar), '') AS d, input_tokens + {PROJECT.format('input_tokens', _LEARNT('t.model'))} AS projected, input_tokens + cast(ceil(output_tokens * {_LEARNT('t.model')}) AS bigint) AS spent FROM turns_monthly t LEFT JOIN multipliers m ON t.model = m.model"),
}
_RULES = ("duplicate", "asked_before", "whole_workspace", "many_references", "snowball", "sensitive", "cache_order", "overkill", "no_cap", "reasoning", "unknown_price")


def _fix(x: str, k: int) -> str:
    return f"printf('%.{k}f', floor({x} * 1e{k} + 0.5) / 1e{k})"


def level(a: str, b: str, s=D) -> str:
    warn, over = (lambda n, budget, share: f"{n} * 100 >= {budget * share}"), 100
    sa, sw, da, dw = warn(a, s.session_budget, over), warn(a, s.session_budget, s.warn_pct), warn(b, s.daily_budget, over), warn(b, s.daily_budget, s.warn_pct)
    return f"CASE WHEN {sa} OR {da} THEN 'over' WHEN {sw} OR {dw} THEN 'warn' ELSE 'ok' END AS level, CASE WHEN {sa} THEN 'session' WHEN {da} THEN 'daily' WHEN {sw} THEN 'session' WHEN {dw} THEN 'daily' END AS budget"


BEFORE = "coalesce(sum(spent) OVER (PARTITION BY {0} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
_USD = "(cost_units / 1e13 * pow(10.0e0, seq % 7))"
_TOK = "(input_tokens * [1, 10, 1000][seq % 3 + 1])"
_TEMPLATE = {"short": f"CASE WHEN {_USD} < 0.01 THEN '$' || {_fix(_USD, 4)} ELSE '$' || {_fix(_USD, 3)} END", "price": f"CASE WHEN {_USD} = 0 THEN '$0' WHEN {_USD} < 0.01 THEN '$' || {_fix(_USD, 4)} WHEN {_USD} < 1 THEN '$' || {_fix(_USD, 3)} ELSE '$' || {_fix(_USD, 2)} END"}
_BIG = f"CASE WHEN {_USD} >= 1000 THEN '$' || {_fix(_USD + ' / 1000', 1)} || 'k' WHEN {_USD} >= 1 THEN '$' || {_fix(_USD, 2)} "

#: name of the query -> (the parts that it reads, SQL).
CHECKS: dict[str, tuple[str, str]] = {
    "price_book": ("book book_of turns", f"SELECT b.ordinal, b.price_key, {usd('b.p_in * 1000000')} AS input_per_m, {usd('b.p_out * 1000000')} AS output_per_m, coalesce(n, 0) AS turns FROM book b LEFT JOIN (SELECT price_key, count(*) AS n FROM turns t JOIN book_of o ON t.model = o.model GROUP BY price_key) u ON b.price_key = u.price_key"),
    "model_prices": ("book_of", f"SELECT model, price_key, {usd('p_in * 1000000')} AS input_per_m, {usd('p_out * 1000000')} AS output_per_m, price_key IS NOT NULL AS matched FROM book_of"),
    "turn_cost": ("turns book_of", f"SELECT seq, t.model, {usd('input_tokens * p_in + output_tokens * p_out')} AS cost_usd FROM turns t JOIN book_of b ON t.model = b.model"),
    "cost_assumed_cache": ("turns book_of", f"SELECT seq, {usd('i')} AS input_cost, {usd('o')} AS output_cost, {usd('i + o')} AS cost FROM (SELECT seq, cast(floor(input_tokens * p_in * {1 - ASSUMED.assumed_cache_fraction * (1 - D.cache_read_multiplier)}e0 + 0.5) AS bigint) AS i, output_tokens * p_out AS o FROM turns t JOIN book_of b ON t.model = b.model)"),
    "cost_real_cache": ("priced", f"SELECT seq, model, coalesce(cached_tokens, 0) AS cached_tokens, {usd('input_units')} AS input_cost, {usd('output_units')} AS output_cost, {usd('cost_units')} AS cost FROM priced"),
    "credit_multiplier": ("turns credit_book", "SELECT model, credit_key, coalesce(cast(multiplier AS double), 1.0e0) AS multiplier, credit_key IS NOT NULL AS matched FROM (SELECT m.model, b.*, row_number() OVER (PARTITION BY m.model ORDER BY length(credit_key) DESC, ordinal) AS n FROM (SELECT DISTINCT model FROM turns) m LEFT JOIN credit_book b ON contains(lower(m.model), credit_key)) WHERE n = 1"),
    "reasoning_flag": ("turns", f"SELECT seq, model, {hint(D.reasoning_hints, 'model')} AS reasoning, {REASON.format('model')} AS multiplier FROM turns"),
    "cheaper_model": ("turns suggested", f"SELECT seq, t.model, pick AS suggestion, {usd('now')} AS current_usd, {usd('best')} AS suggested_usd FROM turns t LEFT JOIN suggested g ON t.model = g.model AND input_tokens = tin AND output_tokens = tout"),
    "cheapest_family": ("turns book_of", f"SELECT DISTINCT t.model, '{CHEAPEST[0]}' AS family, (p_in + p_out) / cast({CHEAPEST[1] + CHEAPEST[2]} AS double) AS times FROM turns t JOIN book_of b ON t.model = b.model"),
    "projected_output": ("turns", f"SELECT seq, model, {PROJECT.format('input_tokens', REASON.format('model'))} AS projected FROM turns"),
    "receipt_delta": ("turns book_of", f"SELECT seq, {usd('est')} AS projected_usd, CASE WHEN est = 0 THEN 0 ELSE cast(floor((act - est) * 100.0e0 / est + 0.5) AS bigint) END AS delta_pct FROM (SELECT seq, input_tokens * p_in + {PROJECT.format('input_tokens', REASON.format('t.model'))} * p_out AS est, (input_tokens + seq % 100) * p_in + cast(ceil(output_tokens * {REASON.format('t.model')}) AS bigint) * p_out AS act FROM turns t JOIN book_of b ON t.model = b.model)"),
    "turn_receipt": ("turns book_of multipliers credit_book", f"""SELECT seq, model, i AS input_total, o AS billed_output, {usd('i * p_in + o * p_out')} AS cost, (SELECT CASE WHEN arg_max(multiplier, length(credit_key)) > 0 THEN cast(arg_max(multiplier, length(credit_key)) AS double) END FROM credit_book c WHERE contains(lower(x.model), credit_key)) AS credits
      FROM (SELECT seq, t.model, p_in, p_out, input_tokens + seq % 100 AS i, cast(ceil(output_tokens * CASE WHEN {hint(D.reasoning_hints, 't.model')} THEN coalesce(l.multiplier, {D.reasoning_multiplier}e0) ELSE 1 END) AS bigint) AS o FROM turns t JOIN book_of b ON t.model = b.model LEFT JOIN multipliers l ON t.model = l.model) x"""),
    "normalize_model": ("", "SELECT p_partkey, trim(regexp_extract(p_type || '/' || p_name || '/ ' || p_brand || ' ', '[^/]*$')) AS model FROM part"),
    "project_name": ("", r"""SELECT c_custkey, coalesce(nullif(regexp_extract(u, '([^/\\]+)[/\\]*$', 1), ''), 'unknown') AS project, lower(regexp_replace(u, '[/\\]+$', '')) AS dir FROM (SELECT c_custkey, CASE WHEN c_custkey % 6 = 5 THEN uri ELSE url_decode(uri) END AS u FROM (
      SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'file:///w/My%20App+x/' WHEN 2 THEN 'file:///w/' || c_name WHEN 3 THEN '///' WHEN 4 THEN 'c:' || chr(92) || 'ws' || chr(92) || c_mktsegment || chr(92) ELSE '/w/100%/' || c_mktsegment END AS uri FROM customer))"""),
    "token_estimate": ("", "SELECT doc_id, cast(ceil(length(text) / 4) AS bigint) AS tokens FROM documents"),
    "finish_reason": ("turns", "SELECT seq, CASE WHEN seq % 13 = 0 THEN 'duplicate_skipped' WHEN seq % 11 = 0 THEN 'length' WHEN seq % 4 > 0 THEN 'tool_calls_then_stop' ELSE 'stop' END AS finish_reason FROM turns"),
    "format_usd": ("priced", f"SELECT seq, {_TEMPLATE['price']} AS price, {_TEMPLATE['short']} AS short, {_BIG} ELSE '$' || {_fix(_USD, 3)} END AS compact, {_BIG} WHEN {_USD} >= 0.001 THEN '$' || {_fix(_USD, 3)} ELSE '$' || {_fix(_USD, 4)} END AS axis, CASE WHEN {_TOK} >= 1000000 THEN {_fix(_TOK + ' / 1e6', 1)} || 'M' WHEN {_TOK} >= 1000 THEN {_fix(_TOK + ' / 1000', 1)} || 'k' ELSE cast({_TOK} AS varchar) END AS tokens_millions, CASE WHEN {_TOK} >= 10000 THEN cast(cast(floor({_TOK} / 1000 + 0.5) AS bigint) AS varchar) || 'k' WHEN {_TOK} >= 1000 THEN {_fix(_TOK + ' / 1000', 1)} || 'k' ELSE cast({_TOK} AS varchar) END AS tokens_panel FROM priced"),
    "turns_union": ("turns", "SELECT source, project, session_id, seq, response_id, model, ts, input_tokens, output_tokens, CASE WHEN source = 'agent' THEN cache_read_tokens END AS cache_read_tokens FROM turns"),
    "turns_dedup": ("deduped", "SELECT source, project, session_id, seq, response_id, model, ts, input_tokens, output_tokens FROM deduped"),
    "turn_index": ("turns", "SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS turn_index FROM turns"),
    "scope_workspace": ("turns", "SELECT source, session_id, seq, model FROM turns WHERE project = 'p3'"),
    "scope_open_folders": ("", "WITH s AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '/w/' || c_mktsegment || '/' WHEN 1 THEN '/W/' || lower(c_mktsegment) ELSE '' END AS working_dir FROM customer), f AS (SELECT DISTINCT lower('/w/' || c_mktsegment) AS dir FROM customer WHERE c_nationkey < 3 AND c_mktsegment LIKE '%U%') SELECT c_custkey, working_dir FROM s WHERE (SELECT count(*) FROM f) = 0 OR lower(rtrim(working_dir, '/')) IN (SELECT dir FROM f)"),
    "usage_by_model": ("priced", f"SELECT model, {TOTALS} FROM priced GROUP BY model ORDER BY cost DESC, model"),
    "usage_by_project": ("priced", f"SELECT project, {TOTALS} FROM priced GROUP BY project ORDER BY cost DESC, project"),
    "usage_daily": ("priced", f"SELECT cast(day AS varchar) AS day, {TOTALS} FROM priced WHERE day IS NOT NULL GROUP BY day"),
    "usage_daily_by_model": ("priced", f"SELECT cast(day AS varchar) AS day, model, {TOTALS} FROM priced WHERE day IS NOT NULL GROUP BY day, model"),
    "usage_cells": ("cells", f"SELECT {_SHOWN} FROM cells"),
    "usage_sessions": ("sessions", f"SELECT {_SESSIONS} FROM sessions"),
    "session_peak_turn": ("priced", "SELECT project, session_id, model, snippet, file, input_tokens FROM (SELECT *, row_number() OVER (PARTITION BY project, session_id ORDER BY input_tokens DESC, seq) AS n FROM priced WHERE input_tokens > 0) WHERE n = 1"),
    "session_detail": ("detail", "SELECT project, session_id, string_agg(place || '|' || coalesce(cast(day AS varchar), 'undated') || '|' || model || '|' || input_tokens || '|' || output_tokens || '|' || printf('%.6f', floor(cost_units / 1e13 * 1e6 + 0.5) / 1e6) || '|' || snippet || '|' || file, ';' ORDER BY place) AS detail FROM detail GROUP BY ALL"),
    "usage_totals": ("priced", f"SELECT {TOTALS}, count(DISTINCT day) AS active_days, count(DISTINCT project) AS projects, count(DISTINCT session_id) AS sessions FROM priced"),
    "usage_grouping_sets": ("priced", f"SELECT model, project, cast(day AS varchar) AS day, grouping(model) AS no_model, grouping(project) AS no_project, grouping(day) AS no_day, {TOTALS} FROM priced GROUP BY GROUPING SETS ((model), (project), (day), (day, model, project), ())"),
    "peak_day": ("daily", f"SELECT cast(day AS varchar) AS day, {usd('cost_units')} AS cost FROM daily ORDER BY cost_units DESC, daily.day LIMIT 1"),
    "top_sessions": ("sessions", f"SELECT {_SESSIONS} FROM sessions ORDER BY input_tokens DESC, project, session_id LIMIT 100"),
    "cells_filtered": ("cells", f"SELECT {_SHOWN} FROM cells WHERE {WANTED} AND (day IS NULL OR day BETWEEN DATE '2024-01-03' AND DATE '2024-01-20')"),
    "session_search": ("sessions detail", """WITH h AS (SELECT project, session_id, string_agg(place, ',' ORDER BY place) AS hits FROM detail WHERE contains(snippet, 'ask 1') OR contains(file, 'ask 1') GROUP BY ALL)
      SELECT s.project, s.session_id, title, coalesce(hits, '') AS hits FROM sessions s LEFT JOIN h ON s.project = h.project AND s.session_id = h.session_id WHERE s.project IN ('p1', 'p2') AND (first_day IS NULL OR first_day BETWEEN DATE '2024-01-03' AND DATE '2024-01-20') AND (hits IS NOT NULL OR contains(lower(title), 'ask 1'))"""),
    "filter_domains": ("cells", "SELECT string_agg(DISTINCT model, ',' ORDER BY model) AS models, string_agg(DISTINCT project, ',' ORDER BY project) AS projects, cast(min(day) AS varchar) AS first_day, cast(max(day) AS varchar) AS last_day FROM cells"),
    "dashboard_cards": ("filtered", f"""WITH t AS (SELECT {usd('sum(cost_units)')} AS cost, {usd('sum(input_units)')} AS input_cost, {usd('sum(output_units)')} AS output_cost, cast(sum(turns) AS bigint) AS turns, cast(sum(input_tokens) AS bigint) AS input_tokens, cast(sum(output_tokens) AS bigint) AS output_tokens, count(DISTINCT model) AS models FROM filtered),
      p AS (SELECT day, sum(cost_units) AS c FROM filtered WHERE day IS NOT NULL GROUP BY day ORDER BY c DESC, day LIMIT 1)
      SELECT t.*, input_cost / cost AS input_share, cost / turns AS cost_per_turn, cast(floor(cost / 0.01e0 + 0.5) AS bigint) AS credits, cast(day AS varchar) AS peak_day, {usd('c')} AS peak_cost FROM t, p"""),
    "trend_delta": ("cells filtered", f"""WITH w AS (SELECT cast(sum(CASE WHEN day >= m - 6 THEN cost_units ELSE 0 END) AS double) AS n, cast(sum(CASE WHEN day < m - 6 AND day >= m - 13 THEN cost_units ELSE 0 END) AS double) AS w FROM filtered, (SELECT max(day) AS m FROM cells)), c AS (SELECT *, CASE WHEN w > 0 THEN (n - w) / w * 100 END AS change_pct FROM w)
      SELECT n / 1e13 AS last_7d, w / 1e13 AS prior_7d, change_pct, CASE WHEN change_pct > 2 THEN 'up' WHEN change_pct < -2 THEN 'down' WHEN change_pct IS NOT NULL THEN 'flat' END AS direction FROM c"""),
    "attribution_share": ("cells", f"SELECT kind, name, {usd('sum(cost_units)')} AS cost, cast(sum(cost_units) AS double) / (SELECT cast(sum(cost_units) AS double) FROM cells) AS share FROM (SELECT 'model' AS kind, model AS name, cost_units FROM cells UNION ALL SELECT 'project', project, cost_units FROM cells) GROUP BY kind, name"),
    "model_efficiency": ("by_model", f"SELECT model, {_RATIO.format('c', 'turns')} AS usd_per_turn, {_RATIO.format('ci * 1000', 'input_tokens')} AS usd_per_1k_in, {_RATIO.format('co * 1000', 'output_tokens')} AS usd_per_1k_out, {_RATIO.format('cast(output_tokens AS double)', 'input_tokens')} AS out_in_ratio, {_RATIO.format('ci * 100', 'c')} AS input_cost_pct FROM (SELECT *, {usd('cost_units')} AS c, {usd('input_units')} AS ci, {usd('output_units')} AS co FROM by_model)"),
    "savings_whatif": ("by_model book_of", f"SELECT '{CHEAPEST[0]}' AS family, v / 1e13 AS savings, v > 5e10 AND v >= 0.05 * t AS emitted FROM (SELECT cast(sum(CASE WHEN p_in + p_out >= {4 * (CHEAPEST[1] + CHEAPEST[2])} THEN greatest(0, cost_units - input_tokens * {CHEAPEST[1]} - output_tokens * {CHEAPEST[2]}) ELSE 0 END) AS double) AS v, cast(sum(cost_units) AS double) AS t FROM by_model m JOIN book_of b ON m.model = b.model)"),
    "insights": ("cells by_model daily sessions book_of", f"""WITH t AS (SELECT cast(sum(cost_units) AS double) AS t, cast(sum(input_units) AS double) AS i, cast(sum(output_units) AS double) AS o FROM cells),
      v AS (SELECT cast(sum(CASE WHEN p_in + p_out >= {4 * (CHEAPEST[1] + CHEAPEST[2])} THEN greatest(0, cost_units - input_tokens * {CHEAPEST[1]} - output_tokens * {CHEAPEST[2]}) ELSE 0 END) AS double) AS v FROM by_model m JOIN book_of b ON m.model = b.model)
      (SELECT 'top_driver' AS insight, model AS subject, cast(cost_units AS double) / t AS share FROM by_model, t ORDER BY cost_units DESC, model LIMIT 1) UNION ALL SELECT 'cheaper_family', '{CHEAPEST[0]}', v / 1e13 FROM v, t WHERE v > 5e10 AND v >= 0.05 * t
      UNION ALL SELECT CASE WHEN i / t >= 0.65 THEN 'input_heavy' ELSE 'output_heavy' END, 'all', CASE WHEN i / t >= 0.65 THEN i / t ELSE o / t END FROM t WHERE i / t >= 0.65 OR o / t >= 0.6
      UNION ALL (SELECT 'priciest_session', session_id, {usd('cost_units')} FROM sessions ORDER BY cost_units DESC, project, session_id LIMIT 1)
      UNION ALL SELECT * FROM (SELECT 'peak_day', cast(day AS varchar), cast(cost_units AS double) / t AS share FROM daily, t ORDER BY cost_units DESC, day LIMIT 1) WHERE share >= 0.4"""),
    "cost_cumulative": ("daily", f"SELECT cast(day AS varchar) AS day, {usd('sum(cost_units) OVER (ORDER BY daily.day)')} AS cumulative FROM daily"),
    "cost_moving_avg": ("daily", f"SELECT cast(day AS varchar) AS day, {usd('sum(cost_units) OVER w')} / count(*) OVER w AS average FROM daily WINDOW w AS (ORDER BY daily.day ROWS 6 PRECEDING)"),
    "cost_stack": ("cells by_model", f"SELECT cast(day AS varchar) AS day, model, {usd('hi - c')} AS lower, {usd('hi')} AS upper FROM (SELECT day, x.model, c, sum(c) OVER (PARTITION BY day ORDER BY m.cost_units DESC, x.model) AS hi FROM (SELECT day, model, sum(cost_units) AS c FROM cells WHERE day IS NOT NULL GROUP BY ALL) x JOIN by_model m ON x.model = m.model)"),
    "daily_top_models": ("cells", f"SELECT cast(day AS varchar) AS day, model, {usd('c')} AS cost, n AS place FROM (SELECT day, model, c, row_number() OVER (PARTITION BY day ORDER BY c DESC, model) AS n FROM (SELECT day, model, sum(cost_units) AS c FROM cells WHERE day IS NOT NULL GROUP BY ALL) WHERE c > 0) WHERE n <= 5"),
    "export_cells": ("filtered", "SELECT coalesce(cast(day AS varchar), 'undated') AS date, model, project, turns, input_tokens, output_tokens, " + ", ".join(f"floor({usd(c + '_units')} * 1e6 + 0.5) / 1e6 AS {n}" for c, n in (("input", "input_cost"), ("output", "output_cost"), ("cost", "cost"))) + " FROM filtered"),
    "calibration_models": ("calibrated", "SELECT * EXCLUDE (ordinal) FROM calibrated"),
    "calibration_baseline": ("baseline", "SELECT baseline FROM baseline"),
    "duplicate_rate": ("usage_log", "SELECT coalesce(avg(cast(duplicate AS int)), 0) AS duplicate_rate FROM usage_log"),
    "context_growth": ("growth", "SELECT * FROM growth"),
    "snowball_p90": ("p90", "SELECT growths, p90 FROM p90"),
    "snowball_threshold": ("p90 usage_log", f"SELECT CASE WHEN (SELECT count(*) FROM usage_log) >= {D.min_turns} THEN coalesce(p90, {D.snowball_tokens}) ELSE {D.snowball_tokens} END AS threshold FROM p90"),
    "calibration_real": ("priced usage_log baseline p90", f"""SELECT m.*, coalesce((SELECT sum(output_tokens) / nullif(cast(sum(input_tokens) AS double), 0) FROM priced WHERE NOT {hint(D.reasoning_hints, 'model')}), baseline) AS baseline, p90, (SELECT avg(cast(duplicate AS int)) FROM usage_log) AS duplicate_rate
      FROM (SELECT model, count(*) AS turns, avg(input_tokens) AS avg_input, avg(output_tokens) AS avg_output, {usd('sum(cast(cost_units AS hugeint))')} / count(*) AS avg_cost, sum(output_tokens) / nullif(cast(sum(input_tokens) AS double), 0) AS out_in_ratio, {hint(D.reasoning_hints, 'model')} AS reasoning FROM priced GROUP BY model) m, baseline, p90"""),
    "calibrated_multiplier": ("multipliers", "SELECT model, multiplier FROM multipliers"),
    "savings_columns": ("turns suggested", f"""SELECT seq, cast(ceil(CASE WHEN seq % 5 = 0 THEN greatest(0, input_tokens - 400) ELSE 0 END / 4) AS bigint) AS tokens_saved_by_compaction, CASE WHEN seq % 13 = 0 THEN input_tokens + {PROJECT.format('input_tokens', REASON.format('t.model'))} ELSE 0 END AS tokens_saved_by_duplicate_block, CASE WHEN seq % 7 = 0 THEN output_tokens ELSE 0 END AS tokens_saved_by_tiering,
      CASE WHEN seq % 13 <> 0 THEN pick END AS suggested_cheaper_model, CASE WHEN seq % 13 <> 0 THEN floor({usd('now - best')} * 1e6 + 0.5) / 1e6 END AS potential_savings_usd FROM turns t LEFT JOIN suggested g ON t.model = g.model AND input_tokens = tin AND output_tokens = tout"""),
    "usage_cells_staged": ("cells", f"SELECT cast(day AS varchar) AS day, model, project, turns, input_tokens, output_tokens, {usd('input_units')} AS input_cost, {usd('output_units')} AS output_cost, {usd('cost_units')} AS cost FROM cells"),
    "usage_open_projects": ("cells", f"SELECT cast(day AS varchar) AS day, model, project, turns, input_tokens, output_tokens, {usd('input_units')} AS input_cost, {usd('output_units')} AS output_cost, {usd('cost_units')} AS cost FROM cells WHERE day BETWEEN '2024-01-03' AND '2024-01-20' AND project IN (SELECT 'p' || (n_nationkey % 9) FROM nation WHERE n_regionkey = 1)"),
    "budget_replay": ("spent", f"""SELECT session_id, seq, cast(su AS bigint) AS session_used, cast(du AS bigint) AS day_used, cast(floor((su + projected) * 100.0e0 / {D.session_budget} + 0.5) AS bigint) AS session_pct, cast(floor((du + projected) * 100.0e0 / {D.daily_budget} + 0.5) AS bigint) AS day_pct, {level('(su + projected)', '(du + projected)')}
      FROM (SELECT *, {BEFORE.format('session_id')} AS su, {BEFORE.format('project, d')} AS du FROM spent)"""),
    "budget_hard_block": ("spent", f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY seq) AS n FROM spent),
      r AS (SELECT DISTINCT project, cast(0 AS bigint) AS n, '' AS session_id, cast(0 AS bigint) AS seq, cast(0 AS bigint) AS su, cast(0 AS bigint) AS du, cast(0 AS bigint) AS projected, map([''], [cast(0 AS bigint)]) AS sessions, map(['-'], [cast(0 AS bigint)]) AS days FROM t
        UNION ALL SELECT project, n, session_id, seq, su, du, projected, CASE WHEN over THEN sessions ELSE map_concat(sessions, map([session_id], [su + spent])) END, CASE WHEN over THEN days ELSE map_concat(days, map([d], [du + spent])) END
        FROM (SELECT t.*, coalesce(r.sessions[t.session_id], 0) AS su, coalesce(r.days[t.d], 0) AS du, coalesce(r.sessions[t.session_id], 0) + t.projected >= {BLOCKING.session_budget} OR coalesce(r.days[t.d], 0) + t.projected >= {BLOCKING.daily_budget} AS over, r.sessions, r.days FROM r JOIN t ON t.project = r.project AND t.n = r.n + 1))
      SELECT session_id, seq, su AS session_used, du AS day_used, {level('(su + projected)', '(du + projected)', BLOCKING)}, su + projected >= {BLOCKING.session_budget} OR du + projected >= {BLOCKING.daily_budget} AS blocked FROM r WHERE n > 0"""),
    "budget_reset": ("spent", f"""SELECT session_id, seq, segment, cast(su AS bigint) AS session_used, {level('(su + projected)', '(du + projected)').split(', CASE')[0]} FROM (SELECT *, {BEFORE.format('session_id, segment')} AS su, {BEFORE.format('project, d')} AS du FROM (SELECT *, cast(sum(CASE WHEN seq % 29 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS bigint) AS segment FROM spent))"""),
    "session_duplicates": ("session_best", "SELECT session_id, seq, similarity FROM session_best"),
    "prompt_index": ("history", "SELECT norm, first, latest, project FROM history ORDER BY latest DESC, norm LIMIT 4000"),
    "history_duplicates": ("history_best", "SELECT * FROM history_best"),
    "guardrail_findings": ("flags", f"SELECT session_id, seq, concat_ws(',', {', '.join(f'CASE WHEN {r} THEN {chr(39)}{r}{chr(39)} END' for r in _RULES)}) AS findings FROM flags"),
    "guardrail_learnt": ("flags_learnt", f"SELECT session_id, seq, projected, concat_ws(',', {', '.join(f'CASE WHEN {r} THEN {chr(39)}{r}{chr(39)} END' for r in _RULES)}) AS findings FROM flags_learnt"),
    "budget_learnt": ("spent_learnt", f"SELECT session_id, seq, cast(projected AS bigint) AS projected, cast(su AS bigint) AS session_used, cast(du AS bigint) AS day_used, {level('(su + projected)', '(du + projected)').split(', CASE')[0]} FROM (SELECT *, {BEFORE.format('session_id')} AS su, {BEFORE.format('project, d')} AS du FROM spent_learnt)"),
    "rule_counts": ("flags", " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) FILTER ({r}) AS prompts FROM flags" for r in _RULES)),
    "duplicate_savings": ("flags book_of", f"SELECT count(*) AS skipped, cast(coalesce(sum(context_tokens), 0) AS bigint) AS input_tokens_saved, cast(coalesce(sum(projected), 0) AS bigint) AS output_tokens_saved, {usd('coalesce(sum(cast(context_tokens * p_in + projected * p_out AS hugeint)), 0)')} AS usd_saved FROM flags f JOIN book_of b ON f.model = b.model WHERE duplicate"),
    "session_anchor": ("prompts", "SELECT session_id, sha256(left(arg_min(prompt, seq), 80)) AS anchor FROM prompts GROUP BY session_id"),
    "edit_roi_files": ("files", "SELECT fs_path, ops, iterations, created, there, array_to_string(models, ',') AS models, verdict FROM files"),
    "model_roi": ("files calibrated", f"SELECT x.*, (SELECT arg_min(avg_cost, ordinal) FROM calibrated c WHERE contains(lower(x.model), lower(c.model)) OR contains(lower(c.model), lower(x.model))) * iterations AS est_cost FROM (SELECT model, count(*) AS files, cast(sum(iterations) AS bigint) AS iterations, {_COUNTS} FROM (SELECT *, unnest(models) AS model FROM files) GROUP BY model) x"),
    "roi_totals": ("files edit_ops", f"SELECT count(*) AS files, {_COUNTS}, bool_or(len(models) > 0) AS attributed, (SELECT count(DISTINCT session_id) FROM edit_ops WHERE starts_with(fs_path, '/ws/app/')) AS sessions FROM files"),
    "roi_top_files": ("files", "SELECT fs_path, iterations, ops, verdict FROM files ORDER BY iterations DESC, ops DESC, fs_path LIMIT 60"),
    "compact_context": ("compacted", "SELECT * FROM compacted"),
    "compaction_savings": ("compacted", "SELECT conv_id, cast(ceil(sum(chars_saved) / 4) AS bigint) AS tokens_saved FROM compacted GROUP BY conv_id HAVING sum(chars_saved) > 0"),
    "cap_tool_result": ("messages", f"SELECT conv_id, turn, CASE WHEN kind = 'tool_result' AND length(text) > {CAPPED.max_tool_result_chars} THEN left(text, {CAPPED.max_tool_result_chars}) || chr(10) || '…[truncated: ' || format('{{:,}}', length(text) - {CAPPED.max_tool_result_chars}) || ' characters left out]' ELSE text END AS text FROM messages"),
    "conversation_context": ("messages", "SELECT conv_id, turn, cast(ceil(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) / 4) AS bigint) AS context_tokens FROM messages"),
    "tool_tiering": ("prompts", f"""WITH p AS (SELECT session_id, seq, {WORDS.format('lower(prompt)', 2)} AS words FROM prompts), t AS (SELECT p_partkey AS ordinal, lower(p_name || ' ' || p_type) AS hay, length(p_name || p_type || p_brand) AS chars FROM part),
      s AS (SELECT session_id, seq, ordinal, chars, row_number() OVER (PARTITION BY session_id, seq ORDER BY len(list_filter(words, lambda w: contains(hay, w))) DESC, ordinal) AS n FROM p, t)
      SELECT session_id, seq, count(*) FILTER (n <= {D.max_tools}) AS kept, cast(ceil(coalesce(sum(chars) FILTER (n > {D.max_tools}), 0) / 4) AS bigint) AS tokens_saved, string_agg(ordinal, ',' ORDER BY ordinal) FILTER (n <= {D.max_tools}) AS kept_ids FROM s GROUP BY session_id, seq"""),
    "strip_chrome": ("messages", rf"SELECT conv_id, turn, regexp_replace(regexp_replace(text || chr(10), '\n---\s*\n', chr(10), 'g') || ' end', '^{SPACES}+|{SPACES}+$', '', 'g') AS text FROM (SELECT conv_id, turn, regexp_replace(text || chr(10), '(?m)^> .*$', '', 'g') AS text FROM messages)"),
    "corpus_grep": ("", "SELECT path, line, left(t, 200) AS text FROM (SELECT path, unnest(range(1, len(lines) + 1)) AS line, unnest(lines) AS t FROM (SELECT source || '/' || lang || '/' || doc_id AS path, string_split_regex(text, '\\r?\\n') AS lines FROM documents WHERE strlen(text) <= 200000 AND source <> 'src3')) WHERE contains(lower(t), 'license') ORDER BY path, line LIMIT 200"),
    "corpus_find": ("", "SELECT source || '/' || lang || '/' || doc_id AS path FROM documents WHERE starts_with(source, 'src1') AND lang IN ('en', 'de') AND doc_id % 10 <> 7 ORDER BY path LIMIT 500"),
    "agent_turns": ("turns", "SELECT session_id, seq, response_id, model, input_tokens, output_tokens, cache_read_tokens FROM turns WHERE source = 'agent' AND input_tokens + output_tokens <> 0"),
}


def statement(parts: str, sql: str) -> str:
    """sql with the parts that it reads, and those that these read, in front; a WITH of its own is kept."""
    need: list[str] = []

    def add(name: str) -> None:
        for x in PARTS[name][0].split():
            add(x)
        if name not in need:
            need.append(name)

    for name in parts.split():
        add(name)
    front = ", ".join(f"{n} AS ({PARTS[n][1]})" for n in need)
    if not front:
        return sql
    for own in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(own):
            return f"{own}{front}, {sql[len(own) :]}"
    return f"WITH {front} {sql}"


def check_sql(name: str) -> str:
    return statement(*CHECKS[name])


def names() -> list[str]:
    """The queries that have a check."""
    return [n for n in QUERIES if n in CHECKS]
