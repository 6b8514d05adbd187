"""DuckDB SQL for the results of the queries that SQL can express."""

from __future__ import annotations

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def later_lines(docs: str) -> str:
    """Common table expressions over a table of documents: `lined`, and `gone`, the numbers (from 1) of the lines that go."""
    return f"""
lined AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM {docs}),
placed AS (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS p FROM lined WHERE doc_id IS NOT NULL),
windowed AS (SELECT doc_id, p, ls[p] AS a, ls[p + 1] AS b, ls[p + 2] AS c FROM placed),
ranked AS (SELECT doc_id, p, rank() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS r FROM windowed WHERE a <> '' OR b <> '' OR c <> ''),
gone AS (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS i FROM ranked WHERE r > 1)"""


def left_lines(docs: str) -> str:
    """later_lines() and `cut`: doc_id, n_lines, n_removed, kept."""
    return (
        later_lines(docs)
        + """,
numbered AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM lined),
remain AS (SELECT n.doc_id, string_agg(line, chr(10) ORDER BY n.i) AS kept FROM numbered n ANTI JOIN gone g ON n.doc_id = g.doc_id AND n.i = g.i GROUP BY 1),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1),
cut AS (SELECT l.doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(n, 0) AS n_removed, coalesce(kept, '') AS kept
  FROM lined l LEFT JOIN remain r ON l.doc_id = r.doc_id LEFT JOIN lost x ON l.doc_id = x.doc_id)"""
    )


OP5 = f"""WITH {left_lines("documents")}
SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM cut"""


def hit_words(docs: str) -> str:
    """Common table expressions: `worded` (doc_id, ws), `hits` (doc_id, item, place)."""
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{SMALL}'), '{pattern}')"
    return f"""
worded AS (SELECT doc_id, {low} AS ws FROM {docs}),
item_words AS (SELECT CAST(item_id AS VARCHAR) AS item, {low} AS ws FROM benchmark),
item_windows AS (SELECT DISTINCT item, ws[p : p + 12] AS w FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS p FROM item_words WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT len(w) AS n FROM item_windows),
doc_windows AS (SELECT doc_id, p, n, ws[p : p + n - 1] AS w FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM worded CROSS JOIN sizes)),
hits AS (SELECT DISTINCT doc_id, item, unnest(range(p, p + n)) AS place FROM doc_windows JOIN item_windows USING (w))"""


def contamination(docs: str) -> str:
    """hit_words() and `judged`: doc_id, n_words, n_hit, n_items, items, contaminated."""
    return (
        hit_words(docs)
        + """,
summed AS (SELECT doc_id, count(DISTINCT place) AS n_hit, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY 1),
judged AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items, '') AS items,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM worded w LEFT JOIN summed s ON w.doc_id = s.doc_id)"""
    )


OP8 = f"""WITH {contamination("documents")}
SELECT doc_id, n_words, n_hit, n_items, sha256(items) AS items_sha256, contaminated FROM judged"""

ORACLES: dict[str, str] = {"op5_line_dedup": OP5, "op8_decontamination": OP8}


def _repair_sql() -> str:
    """The edits by a recursive query, turn by turn; each state holds cost, initials and the lines so far."""

    def more(state: str, cost: str, letters: str, lines: str = "") -> str:
        return f"{{'c': {state}.c + {cost}, 'e': {state}.e || '{letters}', 'o': {state}.o || CAST([{lines}] AS VARCHAR[])}}"

    def least(*states: str) -> str:
        return f"list_sort([{', '.join(states)}])[1]"

    def only(condition: str, state: str) -> str:
        return f"CASE WHEN {condition} THEN {state} ELSE never END"

    own, user, assistant, added_user, added_assistant = "role || ':' || text", "'user:' || text", "'assistant:' || text", "'user:'", "'assistant:'"
    ahead = least("n", "s", "a")
    to_none = more("n", "3", "D")
    to_s = least(more("s", "3", "D"), only("stays AND initial = 's'", more("n", "t", "K", own)))
    to_u = least(
        more("u", "3", "D"),
        only("stays AND initial = 'u'", more("m", "t", "K", own)),
        only("stays AND initial = 'u'", more("u", "t + 2", "IK", f"{added_assistant}, {own}")),
        only("stays", more("m", "t + 2", "R", user)),
        only("stays", more("u", "t + 4", "IR", f"{added_assistant}, {user}")),
    )
    to_a = least(
        more("a", "3", "D"),
        only("stays AND initial = 'a'", more("u", "t", "K", own)),
        only("stays AND initial = 'a'", more("m", "t + 2", "IK", f"{added_user}, {own}")),
        only("stays", more("u", "t + 2", "R", assistant)),
        only("stays", more("m", "t + 4", "IR", f"{added_user}, {assistant}")),
    )
    end = least("n", "a", more("u", "2", "I", added_assistant), more("s", "4", "II", f"{added_user}, {added_assistant}"))
    never = "{'c': 1000000000000, 'e': '', 'o': CAST([] AS VARCHAR[])}"
    zero = "{'c': 0, 'e': '', 'o': CAST([] AS VARCHAR[])}"
    white = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crcs AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(k, ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295) % 20 AS kind FROM keyed),
changed AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM crcs WHERE kind <> 0),
placed AS (SELECT conv_id, turn, role, text, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, right(rtrim(text, {white}), 1) AS ending FROM changed),
nth AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS n, lag(initial) OVER (PARTITION BY conv_id ORDER BY place) AS before FROM placed),
faulty AS (SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN n > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM nth),
turns AS (SELECT conv_id, place, role, text, initial, fault NOT IN ('blank', 'duplicate') AS stays, CAST(fault = 'truncated' AS BIGINT) AS t FROM faulty),
states AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, {zero} AS n, {never} AS s, {never} AS u, {never} AS a, {never} AS never FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, place, {to_none}, {to_s}, {to_u}, {to_a}, never FROM (SELECT x.conv_id, place, role, text, initial, stays, t, n, s, u, a, {ahead} AS m, never FROM states x JOIN turns y ON x.conv_id IS NOT DISTINCT FROM y.conv_id AND y.place = x.i + 1)),
ended AS (SELECT conv_id, {end} AS best FROM states QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY 1)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.e AS audit,
  sha256(array_to_string(best.o, chr(10))) AS repaired_sha256 FROM ended e LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""


OP13 = _repair_sql()
ORACLES["op13_conversation_repair"] = OP13


def _lloyd_sql(k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024) -> str:
    """Each round as common table expressions: every vector against every centroid."""
    numbers = "whole AS MATERIALIZED (SELECT rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM (SELECT row_number() OVER () AS rid, * FROM embeddings) WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})".format(scale=scale, dims=dims)
    start = f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, embedding) - 1 AS c, v AS w FROM (SELECT sha256('{seed}:' || vec_id) AS h, e.embedding, v FROM whole JOIN (SELECT row_number() OVER () AS rid, embedding FROM embeddings) e USING (rid) WHERE vec_id IS NOT NULL ORDER BY h, e.embedding LIMIT {k}))"
    away = "list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"

    def near(i: int) -> str:
        return f"a{i} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := d, c := c)) AS best FROM (SELECT rid, vec_id, v, c, CAST({away} AS BIGINT) AS d FROM whole CROSS JOIN c{i}) GROUP BY rid)"

    def moved(i: int) -> str:
        sums = f"s{i} AS (SELECT c, p, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM (SELECT best.c AS c, unnest(v) AS x, unnest(range({dims})) AS p FROM a{i}) GROUP BY 1, 2)"
        mean = "CAST((s - ((s % n) + n) % n) / n AS BIGINT)"
        return f"{sums},\nm{i} AS (SELECT c, list({mean} ORDER BY p) AS w FROM s{i} GROUP BY 1),\nc{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.w, c{i}.w) AS w FROM c{i} LEFT JOIN m{i} USING (c))"

    steps = [x for i in range(rounds) for x in (near(i), moved(i))]
    end = rounds
    return "WITH " + ",\n".join([numbers, start, *steps, near(end)]) + f"""
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a{end} JOIN c{end} ON best.c = c{end}.c"""


OP11 = _lloyd_sql()
ORACLES["op11_centroid_clusters"] = OP11
