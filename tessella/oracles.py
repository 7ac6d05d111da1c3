"""The engine's queries again, as SQL for an independent engine.

Every query is built from the same few common table expressions: a series, its
windows, the admissible pairs of windows, the best of them.
"""

from __future__ import annotations

import math


def hourly(nan: tuple[int, ...] = (), constant: tuple[int, int] | None = None, name: str = "s", kinds: str | None = None) -> str:
    v = "v"
    if constant:
        v = f"CASE WHEN i BETWEEN {constant[0]} AND {constant[1]} THEN 3.0 ELSE {v} END"
    if nan:
        v = f"CASE WHEN i IN ({', '.join(map(str, nan))}) THEN 'nan'::DOUBLE ELSE {v} END"
    where = f"WHERE event_type = {kinds}" if kinds else ""
    return f"""{name} AS (
  SELECT '0' AS series_id, i, ({v})::DOUBLE AS v FROM (
    SELECT row_number() OVER (ORDER BY t) - 1 AS i, v FROM (
      SELECT date_trunc('hour', ts) AS t, sum(round(value * 100)::BIGINT)::DOUBLE AS v FROM events {where} GROUP BY 1)))"""


def hourly_by_type(gap: str = "'nan'::DOUBLE", name: str = "s") -> str:
    return f"""{name} AS (
  WITH a AS (SELECT event_type, date_trunc('hour', ts) AS t, sum(round(value * 100)::BIGINT)::DOUBLE AS v FROM events GROUP BY ALL),
  g AS (SELECT e.event_type, h.t FROM (SELECT DISTINCT event_type FROM a) e,
        (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS t FROM (SELECT min(t) AS lo, max(t) AS hi FROM a)) h)
  SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY t) - 1 AS i, coalesce(a.v, {gap}) AS v
  FROM g LEFT JOIN a USING (event_type, t))"""


def daily_counts(divide: int = 1, name: str = "s") -> str:
    return f"""{name} AS (
  SELECT '0' AS series_id, i, floor(c / {divide})::DOUBLE AS v FROM (
    SELECT row_number() OVER (ORDER BY t) - 1 AS i, c FROM (
      SELECT date_trunc('day', l_shipdate) AS t, count(*) AS c FROM lineitem GROUP BY 1)))"""


def with_copies(source: str, at: int, of: int, m: int, name: str = "s") -> str:
    """A series whose samples from ``at`` are 2 v + 3 of those from ``of``."""
    return f"""{source}, {name} AS (
  SELECT a.series_id, a.i, CASE WHEN a.i BETWEEN {at} AND {at + m - 1} THEN 2 * b.v + 3 ELSE a.v END AS v
  FROM h a LEFT JOIN h b ON b.i = a.i + {of - at})"""


def windows(m: int, source: str = "s", name: str = "w", constant: str = "list_min(w) = list_max(w)") -> str:
    return f"""{name} AS (
  SELECT series_id, i, w, f, f AND {constant} AS c,
         CASE WHEN f AND list_min(w) < list_max(w)
              THEN list_transform(w, lambda x: (x - list_avg(w)) / list_stddev_pop(w))
              ELSE list_transform(w, lambda x: 0.0::DOUBLE) END AS z
  FROM (SELECT series_id, i, w, len(list_filter(w, lambda x: isfinite(x))) = {m} AS f FROM (
    SELECT series_id, i, list(v) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING) AS w FROM {source})
    WHERE len(w) = {m}))"""


def distance(m: int, normalize: bool, a: str = "a", b: str = "b", snap: bool = True) -> str:
    missing = f"NOT ({a}.f AND {b}.f)"
    if not normalize:
        return f"CASE WHEN {missing} THEN 'inf'::DOUBLE ELSE list_distance({a}.w, {b}.w) END"
    d = f"list_distance({a}.z, {b}.z)"
    snapped = f"CASE WHEN {d} < 1e-7 THEN 0.0 ELSE {d} END" if snap else d
    return f"""CASE WHEN {missing} THEN 'inf'::DOUBLE WHEN {a}.c AND {b}.c THEN 0.0
         WHEN {a}.c OR {b}.c THEN sqrt({m}::DOUBLE) ELSE {snapped} END"""


def pairs(m: int, normalize: bool = True, denom: float = 4, other: str | None = None, source: str = "w", name: str = "p") -> str:
    excl = math.ceil(m / denom)
    on = "" if other else f" AND abs(a.i - b.i) > {excl}"
    key = "b.i" if other else "2 * abs(b.i - a.i) + (b.i > a.i)::INT"
    return f"""{name} AS (
  SELECT * FROM (SELECT a.series_id, a.i, b.i AS j, {distance(m, normalize)} AS d, {key} AS key
  FROM {source} a JOIN {other or source} b ON a.series_id = b.series_id{on}) WHERE isfinite(d))"""


def best(k: int = 1, source: str = "w", p: str = "p") -> str:
    return f"""SELECT w.series_id, w.i::BIGINT AS i, r.rank::INT AS rank, coalesce(round(x.d, 6), 'inf'::DOUBLE) AS p, coalesce(x.j, -1)::BIGINT AS j
FROM {source} w CROSS JOIN (SELECT unnest(range(1, {k + 1})) AS rank) r
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY series_id, i ORDER BY d, key) AS rank FROM {p}) x
  ON x.series_id = w.series_id AND x.i = w.i AND x.rank = r.rank"""


def both_sides(source: str = "w", p: str = "p") -> str:
    one = f"(SELECT series_id, i, arg_min(j, (d, key)) AS j FROM {p} WHERE j {{}} i GROUP BY ALL)"
    return f"""SELECT w.series_id, w.i::BIGINT AS i, coalesce(l.j, -1)::BIGINT AS left_j, coalesce(r.j, -1)::BIGINT AS right_j
FROM {source} w LEFT JOIN {one.format('<')} l USING (series_id, i) LEFT JOIN {one.format('>')} r USING (series_id, i)"""


def profile(series: str, m: int, k: int = 1, normalize: bool = True, denom: float = 4, constant: str = "list_min(w) = list_max(w)") -> str:
    return f"WITH {series}, {windows(m, constant=constant)}, {pairs(m, normalize, denom)}\n{best(k)}"


def long_profile(series: str, m: int) -> str:
    """First neighbours in a series of many windows: fixed-size arrays, and one aggregate over the pairs."""
    d = "array_distance(a.z, b.z)"
    key = "2 * abs(b.i - a.i) + (b.i > a.i)::INT"
    return f"""WITH {series}, {windows(m)}, x AS (SELECT i, z::DOUBLE[{m}] AS z FROM w WHERE f),
n AS (SELECT i, min((d, key, j)) AS best FROM (
  SELECT a.i, b.i AS j, CASE WHEN {d} < 1e-7 THEN 0.0 ELSE {d} END AS d, {key} AS key FROM x a JOIN x b ON abs(a.i - b.i) > {math.ceil(m / 4)})
  GROUP BY i)
SELECT w.series_id, w.i::BIGINT AS i, coalesce(round(best[1], 6), 'inf'::DOUBLE) AS p, coalesce(best[3], -1)::BIGINT AS j FROM w LEFT JOIN n USING (i)"""


def sides(series: str, m: int, normalize: bool = True) -> str:
    return f"WITH {series}, {windows(m)}, {pairs(m, normalize)}\n{both_sides()}"


def ab(series: str, other: str, m: int, normalize: bool, k: int = 1) -> str:
    return f"WITH {series}, {other}, {windows(m)}, {windows(m, 't', 'u')}, {pairs(m, normalize, other='u')}\n{best(k)}"


def query_profile(series: str, m: int, at: int, normalize: bool, own: bool = False) -> str:
    """CTEs up to d(j, d): distances of the window at ``at`` to all."""
    d = distance(m, normalize, snap=False)
    if own:
        d = f"CASE WHEN b.i = {at} THEN 0.0 ELSE {d} END"
    return f"""{series}, {windows(m)}, d AS (
  SELECT b.series_id, b.i AS j, {d} AS d FROM (SELECT * FROM w WHERE i = {at}) a JOIN w b USING (series_id))"""


def matches(series: str, m: int, at: int, normalize: bool = True, cutoff: str | None = None, most: int = 1000, first: int | None = None, own: bool = False) -> str:
    excl = math.ceil(m / 4)
    cut = cutoff or "(SELECT greatest(avg(d) - 2 * stddev_pop(d), min(d)) FROM d WHERE isfinite(d))"
    start = f"WHERE j = {first}" if first is not None else ""
    return f"""WITH RECURSIVE {query_profile(series, m, at, normalize, own)},
c AS (SELECT j, d FROM d WHERE isfinite(d) AND d <= {cut} + 1e-8),
g AS (
  SELECT * FROM (SELECT 1 AS rank, j, d, [j] AS taken FROM c {start} ORDER BY d, j LIMIT 1)
  UNION ALL
  SELECT * FROM (SELECT g.rank + 1, c.j, c.d, list_append(g.taken, c.j) FROM g, c
    WHERE g.rank < {most} AND len(list_filter(g.taken, lambda x: abs(x - c.j) <= {excl})) = 0 ORDER BY c.d, c.j LIMIT 1))
SELECT '0' AS query_id, '0' AS series_id, rank::INT AS rank, round(d, 6) AS d, j::BIGINT AS j FROM g"""


def discords(series: str, m: int, k: int) -> str:
    excl = math.ceil(m / 4)
    return f"""WITH RECURSIVE {series}, {windows(m)}, {pairs(m)},
n AS (SELECT i, min(d) AS d FROM p GROUP BY i),
g AS (
  SELECT * FROM (SELECT 1 AS rank, i, d, [i] AS taken FROM n ORDER BY d DESC, i LIMIT 1)
  UNION ALL
  SELECT * FROM (SELECT g.rank + 1, n.i, n.d, list_append(g.taken, n.i) FROM g, n
    WHERE g.rank < {k} AND len(list_filter(g.taken, lambda x: abs(x - n.i) <= {excl})) = 0 ORDER BY n.d DESC, n.i LIMIT 1))
SELECT '0' AS series_id, rank::INT AS rank, round(d, 6) AS p, i::BIGINT AS i FROM g"""


def motif(series: str, m: int) -> str:
    return f"""WITH {series}, {windows(m)}, {pairs(m)}, n AS (SELECT i, min(d) AS p, arg_min(j, (d, key)) AS j FROM p GROUP BY i)
SELECT '0' AS series_id, round(p, 6) AS p, i::BIGINT AS i, j::BIGINT AS j FROM n ORDER BY n.p, n.i LIMIT 1"""


def pan_profiles(series: str, rows: list[tuple[int, int, int]], normalize: bool = True) -> str:
    """CTEs up to pr(pan_row, upd, m, i, p) for rows (pan_row, upd, m)."""
    ctes, parts = [series], []
    for row, upd, m in rows:
        ctes += [windows(m, name=f"w{row}"), pairs(m, normalize, source=f"w{row}", name=f"p{row}")]
        parts.append(f"""SELECT {row} AS pan_row, {upd} AS upd, {m} AS m, w.i, coalesce(x.d, 'inf'::DOUBLE) AS p
  FROM w{row} w LEFT JOIN (SELECT i, min(d) AS d FROM p{row} GROUP BY i) x USING (i)""")
    return ",\n".join(ctes) + ",\npr AS (" + "\n  UNION ALL ".join(parts) + ")"


def pan_picture(series: str, rows: list[tuple[int, int, int]], n_rows: int, threshold: float = 0.2, contrast: bool = True, binary: bool = True, normalize: bool = True) -> str:
    span = "2" if normalize else "(SELECT max(v) - min(v) FROM s WHERE isfinite(v))"
    value = f"least(1.0, v / ({span} * sqrt(m)))"
    t = threshold
    steps = [f"x0 AS (SELECT pan_row, upd, i, CASE WHEN v IS NULL THEN NULL ELSE {value} END AS v FROM cells)"]
    last = "x0"
    if contrast:
        steps.append(f"""x1 AS (SELECT pan_row, upd, i, 1 / (1 + exp(-10 * (q - {t}))) AS v FROM (
    SELECT pan_row, upd, i, (row_number() OVER (ORDER BY v ASC NULLS LAST, upd, i) - 1) / greatest(count(*) OVER () - 1, 1)::DOUBLE AS q FROM x0))""")
        last = "x1"
    if binary:
        steps.append(f"x2 AS (SELECT pan_row, upd, i, CASE WHEN v <= {t} THEN 0.0 ELSE 1.0 END AS v FROM {last})")
        last = "x2"
    steps.append(f"x3 AS (SELECT pan_row, i, CASE WHEN v IS NULL THEN NULL ELSE greatest(0.0, least(1.0, v)) END AS v FROM {last})")
    return f"""WITH {pan_profiles(series, rows, normalize)},
cells AS (SELECT r.pan_row, r.upd, r.m, s.i, CASE WHEN isfinite(pr.p) THEN pr.p END AS v
  FROM (SELECT DISTINCT pan_row, upd, m FROM pr) r CROSS JOIN s LEFT JOIN pr ON pr.pan_row = r.pan_row AND pr.i = s.i),
{", ".join(steps)},
src AS (SELECT r.pan_row, (SELECT min(pan_row) FROM x3 WHERE x3.pan_row >= r.pan_row) AS src FROM (SELECT unnest(range({n_rows})) AS pan_row) r),
full_rows AS (SELECT src.pan_row, s.i, x3.v FROM src CROSS JOIN s LEFT JOIN x3 ON x3.pan_row = src.src AND x3.i = s.i)
SELECT '0' AS series_id, pan_row::INT AS pan_row, i::BIGINT AS i, round(coalesce(v, max(v) OVER ()), 6) AS value FROM full_rows"""
