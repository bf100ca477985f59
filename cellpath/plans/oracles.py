"""The registered queries once more, as SQL for an independent engine.

Written from the rules, not from the Spark plans: slots come from a range join over
uncollapsed pings, loops are unrolled into one CTE per round.
"""

from __future__ import annotations

from cellpath.plans.catalog import K, MODES_K, ROUNDS, USER
from cellpath.schema import SEED

DAY = "user_id, year, month, day"

PINGS = """
pings AS MATERIALIZED (
  SELECT user_id, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day,
         (hour(ts) * 60 + minute(ts))::INT AS minute_of_day,
         (json_extract_string(props, '$.k')::INT % 10)::INT AS cell_id, event_id AS ord
  FROM events)"""


def _slots(interval: int = 60) -> str:
    """``day_slots(user, day, slot, cell_id)`` before filling gaps."""
    return f"""
seg AS (
  SELECT {DAY}, minute_of_day AS en, cell_id AS own,
         coalesce(lag(minute_of_day) OVER w, 0) AS st, coalesce(lag(cell_id) OVER w, -1) AS held
  FROM pings WINDOW w AS (PARTITION BY {DAY} ORDER BY minute_of_day, ord)),
final AS (
  SELECT {DAY}, max(minute_of_day) // {interval} AS last_slot,
         arg_max(cell_id, minute_of_day * 1000000000000 + ord) AS last_cell
  FROM pings GROUP BY ALL),
grid AS (SELECT f.*, s.slot FROM final f, (SELECT range::INT AS slot FROM range({1440 // interval})) s),
part AS (
  SELECT {DAY}, slot, held AS cell_id,
         least(en, (slot + 1) * {interval}) - greatest(st, slot * {interval}) AS dwell
  FROM seg JOIN (SELECT range::INT AS slot FROM range({1440 // interval})) s
    ON slot BETWEEN st // {interval} AND en // {interval}
  UNION ALL
  SELECT {DAY}, (en // {interval})::INT, own, 0 FROM seg),
slot_dwell AS (
  SELECT {DAY}, slot, cell_id, sum(dwell)::BIGINT AS dwell FROM part GROUP BY ALL),
pinged AS (SELECT DISTINCT {DAY}, (en // {interval})::INT AS slot FROM seg),
winner AS (
  SELECT {DAY}, slot, cell_id AS best_cell, dwell AS best_dwell FROM slot_dwell WHERE cell_id <> 1
  QUALIFY row_number() OVER (PARTITION BY {DAY}, slot ORDER BY dwell DESC, cell_id = -1, cell_id) = 1),
day_slots AS MATERIALIZED (
  SELECT g.user_id, g.year, g.month, g.day, g.slot,
         (CASE WHEN g.slot >= g.last_slot THEN g.last_cell
               WHEN p.slot IS NOT NULL THEN coalesce(w.best_cell, -1)
               ELSE d.cell_id END)::INT AS cell_id
  FROM grid g
  LEFT JOIN pinged p USING ({DAY}, slot)
  LEFT JOIN winner w USING ({DAY}, slot)
  LEFT JOIN slot_dwell d ON p.slot IS NULL AND g.slot < g.last_slot AND d.user_id = g.user_id
    AND d.year = g.year AND d.month = g.month AND d.day = g.day AND d.slot = g.slot)"""


def _filled(strict: bool = True, slots: int = 24) -> str:
    """``filled(user, day, slot, cell_id)`` and its text form ``vec(user, day, cells)``."""
    first = "lag(day, 2) OVER w = day - 2" if strict else "TRUE"
    return f"""
ends AS (
  SELECT {DAY}, max(cell_id) FILTER (slot = {slots - 1}) AS last_cell, min(slot) FILTER (cell_id <> -1) AS known_from
  FROM day_slots GROUP BY ALL),
fills AS (
  SELECT {DAY}, known_from,
         CASE WHEN lag(day, 1) OVER w = day - 1 AND {first} THEN lag(last_cell) OVER w ELSE -1 END AS fill
  FROM ends WINDOW w AS (PARTITION BY user_id, year, month ORDER BY day)),
filled AS MATERIALIZED (
  SELECT {DAY}, slot, (CASE WHEN slot < coalesce(known_from, {slots}) THEN fill ELSE cell_id END)::INT AS cell_id
  FROM day_slots JOIN fills USING ({DAY}))"""


BASE = PINGS + "," + _slots()
FILLED = BASE + "," + _filled()


def _test_points(filled: str, interval: int = 60) -> str:
    return filled + f""",
drawn AS (
  SELECT *, md5(concat_ws('|', user_id, year, month, day, slot, {SEED})) AS h FROM filled),
test_points AS MATERIALIZED (
  SELECT {DAY}, (slot * {interval} + ('0x' || substr(h, 9, 8))::BIGINT % {interval})::INT AS minute, cell_id
  FROM drawn QUALIFY row_number() OVER (PARTITION BY {DAY} ORDER BY h, slot) <= 4),
seqs AS MATERIALIZED (
  SELECT {DAY}, max(minute)::INT AS next_minute, arg_max(cell_id, minute)::INT AS actual_cell
  FROM test_points GROUP BY ALL),
past AS (
  SELECT t.*, (t.minute // {interval})::INT AS slot, s.next_minute, s.actual_cell
  FROM test_points t JOIN seqs s USING ({DAY}) WHERE t.minute < s.next_minute)"""


TEST_POINTS = _test_points(FILLED)


def _split_ctes() -> str:
    draw = f"('0x' || substr(md5(concat_ws('|', user_id, year, month, day, {SEED})), 1, 8))::BIGINT % 100 < 80"
    return f"""
split AS (SELECT *, {draw} AS is_train FROM filled)"""


def _centres0(k: int, pooled: bool, source: str = "filled") -> str:
    """Points ``pt(g, user, day, slot, x)`` and initial centres ``c0(g, cluster_id, slot, c)``."""
    group = "0" if pooled else "user_id"
    return f"""
pt AS MATERIALIZED (SELECT {group} AS g, {DAY}, slot, cell_id AS x FROM {source}),
draw AS (
  SELECT g, {DAY}, row_number() OVER (
    PARTITION BY g ORDER BY md5(concat_ws('|', user_id, year, month, day, {SEED})), {DAY}) - 1 AS cluster_id
  FROM (SELECT DISTINCT g, {DAY} FROM pt)),
c0 AS MATERIALIZED (
  SELECT g, cluster_id::INT AS cluster_id, slot, x AS c FROM draw JOIN pt USING (g, {DAY}) WHERE cluster_id < {k})"""


SQUARED = "(x - c)::BIGINT * (x - c)::BIGINT"
DIFFERENT = "(x <> c)::BIGINT"


def _assign(i: int, metric: str = SQUARED) -> str:
    return f"""
a{i} AS MATERIALIZED (
  SELECT g, {DAY}, cluster_id, dist FROM (
    SELECT p.g, {DAY}, cluster_id, sum({metric})::BIGINT AS dist
    FROM pt p JOIN c{i} c ON p.g = c.g AND p.slot = c.slot GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY g, {DAY} ORDER BY dist, cluster_id) = 1)"""


def _update(i: int, method: str) -> str:
    """Centres ``c{i+1}`` from assignment ``a{i}``."""
    if method == "kmeans":
        return f"""
c{i + 1} AS MATERIALIZED (
  SELECT o.g, o.cluster_id, o.slot, coalesce(n.c, o.c)::INT AS c
  FROM c{i} o LEFT JOIN (
    SELECT g, cluster_id, slot, (sum(x)::BIGINT // count(*)) AS c
    FROM a{i} JOIN pt USING (g, {DAY}) GROUP BY ALL) n USING (g, cluster_id, slot))"""
    return f"""
c{i + 1} AS MATERIALIZED (
  SELECT g, cluster_id, slot, x::INT AS c FROM (
    SELECT g, cluster_id, slot, x, count(*) AS freq FROM a{i} JOIN pt USING (g, {DAY}) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY g, cluster_id, slot ORDER BY freq DESC, x) = 1)"""


def _rounds(n: int, method: str, k: int, pooled: bool = False, source: str = "filled", metric: str = SQUARED) -> str:
    """``n`` full rounds: centres up to ``c{n}``."""
    ctes = [_centres0(k, pooled, source)]
    for i in range(n):
        ctes += [_assign(i, metric), _update(i, method)]
    return ",".join(ctes)


def _model(
    method: str, k: int, pooled: bool = False, source: str = "filled", metric: str = SQUARED, interval: int = 60
) -> str:
    """``counts`` and ``model`` after the rounds."""
    rounds = ROUNDS if method == "kmeans" else ROUNDS - 1
    return _rounds(rounds, method, k, pooled, source, metric) + "," + _assign(rounds, metric) + f""",
counts AS (
  SELECT g AS user_id, cluster_id, slot, x AS cell_id, count(*) AS freq
  FROM a{rounds} JOIN pt USING (g, {DAY}) GROUP BY a{rounds}.g, cluster_id, slot, x),
top AS (
  SELECT *, (row_number() OVER (PARTITION BY user_id, cluster_id, slot ORDER BY freq DESC, cell_id))::INT AS rank
  FROM counts QUALIFY rank <= 3),
model AS MATERIALIZED (
  SELECT user_id, cluster_id, slot, rank, cell_id, freq,
         freq::DOUBLE / (sum(freq) OVER (PARTITION BY user_id, cluster_id, slot))::DOUBLE AS prob,
         {interval} AS interval_minutes
  FROM top)"""


SEQ = f"{DAY}, next_minute, actual_cell"


def _predicted(pooled: bool = False, interval: int = 60) -> str:
    group = "0" if pooled else "s.user_id"
    point_group = "0" if pooled else "p.user_id"
    return f"""
scored AS (
  SELECT p.user_id, p.year, p.month, p.day, next_minute, actual_cell, m.cluster_id, round(sum(m.prob), 12) AS score
  FROM past p JOIN model m ON m.user_id = {point_group} AND m.slot = p.slot AND m.cell_id = p.cell_id GROUP BY ALL),
every AS (
  SELECT {', '.join('s.' + c.strip() for c in SEQ.split(','))}, c.cluster_id, coalesce(x.score, 0.0::DOUBLE) AS score
  FROM seqs s
  JOIN (SELECT DISTINCT user_id AS g, cluster_id FROM model) c ON c.g = {group}
  LEFT JOIN scored x ON x.user_id = s.user_id AND x.year = s.year AND x.month = s.month AND x.day = s.day
    AND x.cluster_id = c.cluster_id),
best AS MATERIALIZED (
  SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY {DAY} ORDER BY score DESC, cluster_id) = 1),
pred AS MATERIALIZED (
  SELECT {', '.join('s.' + c.strip() for c in SEQ.split(','))}, s.cluster_id, s.score, m.rank, m.cell_id, m.prob
  FROM best s JOIN model m ON m.user_id = {group} AND m.cluster_id = s.cluster_id AND m.slot = s.next_minute // {interval}),
hits AS (
  SELECT rank, sum((cell_id = actual_cell)::INT)::BIGINT AS hits,
         (SELECT count(*) FROM seqs) AS n_predictions
  FROM pred GROUP BY rank)"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def _raw_line() -> str:
    """Raw lines as built from events, with the reason for which a line is bad."""
    def line(month: str = "month", hour: str = "minute_of_day // 60", tail: str = "|| ',' || cell_id") -> str:
        return (
            f"user_id || ',' || year || ',' || {month} || ',' || day || ',' "
            f"|| (dayofweek(make_date(year, month, day)) + 1) || ',' || ({hour}) || ',' || (minute_of_day % 60) || ',area' {tail}"
        )
    return PINGS + f""",
raw AS (
  SELECT p.*, CASE
    WHEN event_type = 'error' AND value < 10 THEN {line(tail='')}
    WHEN event_type = 'error' AND value < 20 THEN {line(month="' ' || month || ' '")}
    WHEN event_type = 'error' AND value < 30 THEN {line(month="month || '.7'")}
    WHEN event_type = 'error' AND value < 40 THEN {line(tail="|| ',99999999999'")}
    WHEN event_type = 'error' THEN ''
    WHEN event_type = 'signup' THEN {line(hour='24')} END AS bad,
    CASE event_type WHEN 'error' THEN 'malformed' WHEN 'signup' THEN 'minute out of range' END AS reason
  FROM pings p JOIN (SELECT event_id, event_type, value FROM events) e ON e.event_id = p.ord)"""


def _damaged(payload: str, source: str) -> str:
    """``damaged(day, value)``: text lines, those of days 1 to 6 damaged."""
    return f"""
damaged AS (
  SELECT day, CASE day
    WHEN 1 THEN concat_ws('|', user_id, year, month, day)
    WHEN 2 THEN concat_ws('|', '', year, month, day, payload)
    WHEN 3 THEN concat_ws('|', user_id, ' ' || year, month, day, payload)
    WHEN 4 THEN concat_ws('|', user_id, year, month, day, payload) || 'x'
    WHEN 5 THEN concat_ws('|', user_id, year, month, day, payload) || '|'
    WHEN 6 THEN concat_ws('|', user_id, year, month, day, payload) || ',7'
    ELSE concat_ws('|', user_id, year, month, day, payload) END AS value
  FROM (SELECT {DAY}, {payload} AS payload FROM {source} GROUP BY {DAY}))"""


_REJECTS = """SELECT value, CASE WHEN day IN (1, 2, 3, 5) THEN 'malformed' WHEN day = 4 THEN {four} WHEN day = 6 THEN {six} END AS reason FROM damaged"""
VEC = "string_agg(cell_id::VARCHAR, ',' ORDER BY slot)"
CENTRES = "SELECT g AS user_id, cluster_id, slot, c AS cell_id FROM {}"
MODEL = "SELECT user_id, cluster_id, slot, rank, cell_id, freq, prob, interval_minutes FROM model"
HITS = "SELECT rank, hits, n_predictions, hits::DOUBLE / n_predictions AS hit_rate FROM hits"


def oracle_sql() -> dict[str, str]:
    kmeans = FILLED + "," + _model("kmeans", K)
    predicted = TEST_POINTS + "," + _model("kmeans", K) + "," + _predicted()
    half_hours = PINGS + "," + _slots(30) + "," + _filled(slots=48)
    pooled_model = _with(FILLED + "," + _model("kmodes", MODES_K, True), MODEL.replace("user_id, ", ""))
    pooled_hits = _with(TEST_POINTS + "," + _model("kmodes", MODES_K, True) + "," + _predicted(pooled=True), HITS)
    good = _raw_line().replace("pings AS MATERIALIZED", "all_pings AS MATERIALIZED").replace("FROM pings p", "FROM all_pings p") + """,
pings AS MATERIALIZED (SELECT * EXCLUDE (bad, reason) FROM raw WHERE reason IS NULL)"""
    wide = ", ".join(f"max(cell_id) FILTER (slot = {s}) AS h{s:02d}" for s in range(24))
    held_out = TEST_POINTS.replace("FROM filled)", "FROM test_days)")
    return {
        "pings_parse": _with(
            _raw_line(),
            "SELECT user_id::VARCHAR AS user_id, year, month, day, minute_of_day, cell_id, ord FROM raw WHERE reason IS NULL",
        ),
        "pings_rejects": _with(_raw_line(), "SELECT bad AS value, ord, reason FROM raw WHERE reason IS NOT NULL"),
        "minute_of_day": _with(PINGS, "SELECT ord, minute_of_day FROM pings"),
        "user_filter": _with(PINGS, f"SELECT * FROM pings WHERE user_id = {USER}"),
        "daily_sequences": _with(
            PINGS,
            f"""SELECT {DAY}, (seq_no // 1440)::BIGINT AS part_no,
       string_agg(minute_of_day || ',' || cell_id, '!' ORDER BY seq_no) AS points
FROM (SELECT *, row_number() OVER (PARTITION BY {DAY} ORDER BY minute_of_day, ord) - 1 AS seq_no FROM pings)
GROUP BY ALL""",
        ),
        "records_per_user_month": _with(
            PINGS,
            "SELECT user_id, year, month, count(*) AS n_pings, count(DISTINCT day) AS n_days FROM pings GROUP BY ALL",
        ),
        "dwell_segments": _with(
            PINGS,
            f"""SELECT {DAY}, coalesce(lag(minute_of_day) OVER w, 0)::INT AS start_minute, minute_of_day AS end_minute,
       coalesce(lag(cell_id) OVER w, -1)::INT AS cell_id
FROM (SELECT * FROM pings QUALIFY row_number() OVER (PARTITION BY {DAY}, minute_of_day ORDER BY ord DESC) = 1)
WINDOW w AS (PARTITION BY {DAY} ORDER BY minute_of_day)""",
        ),
        "slot_dwell": _with(BASE, "SELECT * FROM slot_dwell"),
        "dominant_cell_no_lost_signal": _with(
            BASE,
            f"""SELECT {DAY}, slot, coalesce(best_cell, -1)::INT AS cell_id, coalesce(best_dwell, 0)::INT AS dwell
FROM (SELECT DISTINCT {DAY}, slot FROM slot_dwell) LEFT JOIN winner USING ({DAY}, slot)""",
        ),
        "day_slots": _with(BASE, "SELECT * FROM day_slots"),
        "day_slots_30min": _with(PINGS + "," + _slots(30), "SELECT * FROM day_slots"),
        "day_vectors": _with(BASE, f"SELECT {DAY}, {wide} FROM day_slots GROUP BY ALL"),
        "day_slots_backfilled": _with(FILLED, "SELECT * FROM filled"),
        "day_slots_backfilled_lenient": _with(BASE + "," + _filled(strict=False), "SELECT * FROM filled"),
        "unknown_slot_share": _with(
            FILLED,
            """SELECT slot, count(*) AS n_days, count(*) FILTER (cell_id = -1) AS n_unknown,
       (count(*) FILTER (cell_id = -1))::DOUBLE / count(*) AS unknown_share FROM filled GROUP BY slot""",
        ),
        "test_points": _with(TEST_POINTS, "SELECT * FROM test_points"),
        "test_sequences_text": _with(
            TEST_POINTS,
            f"""SELECT concat_ws('|', user_id, year, month, day,
       string_agg(minute || ',' || cell_id, '!' ORDER BY minute)) AS value FROM test_points GROUP BY {DAY}""",
        ),
        "past_future_split": _with(
            TEST_POINTS,
            f"SELECT {SEQ}, string_agg(minute || ',' || cell_id, '!' ORDER BY minute) AS past FROM past GROUP BY {SEQ}",
        ),
        "train_test_split": _with(FILLED + "," + _split_ctes(), f"SELECT DISTINCT {DAY}, is_train FROM split"),
        "initial_centres": _with(FILLED + "," + _centres0(K, False), CENTRES.format("c0")),
        "nearest_centre": _with(
            FILLED + "," + _centres0(K, False) + "," + _assign(0), f"SELECT {DAY}, cluster_id, dist AS distance FROM a0"
        ),
        "nearest_centre_hamming": _with(
            FILLED + "," + _centres0(K, False) + "," + _assign(0, DIFFERENT),
            f"SELECT {DAY}, cluster_id, dist AS distance FROM a0",
        ),
        "kmeans_step": _with(FILLED + "," + _rounds(1, "kmeans", K), CENTRES.format("c1")),
        "kmeans_centres": _with(FILLED + "," + _rounds(ROUNDS, "kmeans", K), CENTRES.format(f"c{ROUNDS}")),
        "kmodes_step": _with(FILLED + "," + _rounds(1, "kmodes", K), CENTRES.format("c1")),
        "kmodes_centres": _with(FILLED + "," + _rounds(ROUNDS, "kmodes", MODES_K), CENTRES.format(f"c{ROUNDS}")),
        "kmodes_centres_hamming": _with(
            FILLED + "," + _rounds(ROUNDS, "kmodes", MODES_K, metric=DIFFERENT), CENTRES.format(f"c{ROUNDS}")
        ),
        "kmodes_centres_pooled": _with(
            FILLED + "," + _rounds(ROUNDS, "kmodes", MODES_K, True),
            f"SELECT cluster_id, slot, c AS cell_id FROM c{ROUNDS}",
        ),
        "kmeans_centres_pooled": _with(
            FILLED + "," + _rounds(ROUNDS, "kmeans", K, True),
            f"SELECT cluster_id, slot, c AS cell_id FROM c{ROUNDS}",
        ),
        "cluster_slot_counts": _with(kmeans, "SELECT * FROM counts"),
        "cluster_topk": _with(kmeans, "SELECT * FROM top"),
        "model_kmeans": _with(kmeans, MODEL),
        "model_kmodes": _with(FILLED + "," + _model("kmodes", MODES_K), MODEL),
        "model_kmodes_hamming": _with(FILLED + "," + _model("kmodes", MODES_K, metric=DIFFERENT), MODEL),
        "model_kmeans_30min": _with(half_hours + "," + _model("kmeans", K, interval=30), MODEL),
        "model_kmodes_pooled": pooled_model,
        "model_count": _with(kmeans, "SELECT count(*) AS n_models FROM (SELECT DISTINCT user_id, cluster_id FROM model)"),
        "model_scores": _with(predicted, f"SELECT {SEQ}, cluster_id, score FROM scored"),
        "best_model": _with(predicted, f"SELECT {SEQ}, cluster_id, score FROM best"),
        "predict_next": _with(predicted, "SELECT * FROM pred"),
        "predicted_vs_actual": _with(predicted, f"SELECT {SEQ}, rank, cell_id, (cell_id = actual_cell)::INT AS hit FROM pred"),
        "rank_hits": _with(predicted, HITS),
        "rank_hits_30min": _with(
            _test_points(half_hours, 30) + "," + _model("kmeans", K, interval=30) + "," + _predicted(interval=30), HITS
        ),
        "rank_hits_repeated": _with(
            predicted,
            "SELECT rank, (3 * hits)::BIGINT AS hits, (3 * n_predictions)::BIGINT AS n_predictions, "
            "hits::DOUBLE / n_predictions AS hit_rate FROM hits",
        ),
        "rank_hits_from_store": pooled_hits,
        "rank_hits_held_out": _with(
            held_out.replace("drawn AS (", _split_ctes() + f""",
train_days AS MATERIALIZED (SELECT {DAY}, slot, cell_id FROM split WHERE is_train),
test_days AS MATERIALIZED (SELECT {DAY}, slot, cell_id FROM split WHERE NOT is_train),
drawn AS (""") + "," + _model("kmeans", K, source="train_days") + "," + _predicted(),
            HITS,
        ),
        "rank_hits_pooled": pooled_hits,
        "hit_rate_topk": _with(
            predicted,
            """SELECT rank, (sum(hits) OVER (ORDER BY rank))::BIGINT AS hits_up_to_rank, n_predictions,
       (sum(hits) OVER (ORDER BY rank))::DOUBLE / n_predictions AS hit_rate FROM hits""",
        ),
        "day_vectors_text": _with(
            FILLED, f"SELECT concat_ws('|', user_id, year, month, day, {VEC}) AS value FROM filled GROUP BY {DAY}"
        ),
        "day_vectors_roundtrip": _with(
            FILLED, "SELECT user_id::VARCHAR AS user_id, year, month, day, slot, cell_id FROM filled"
        ),
        "test_sequences_roundtrip": _with(
            TEST_POINTS, "SELECT user_id::VARCHAR AS user_id, year, month, day, minute, cell_id FROM test_points"
        ),
        "model_store_roundtrip": _with(kmeans, MODEL),
        "model_store_roundtrip_pooled": pooled_model,
        "pings_from_text": _with(
            _raw_line(),
            "SELECT user_id::VARCHAR AS user_id, year, month, day, minute_of_day, cell_id FROM raw WHERE reason IS NULL",
        ),
        "prepare_job": _with(
            _test_points(good + "," + _slots() + "," + _filled()),
            f"""SELECT 'day' AS kind, concat_ws('|', user_id, year, month, day, {VEC}) AS value FROM filled GROUP BY {DAY}
UNION ALL SELECT 'sequence', concat_ws('|', user_id, year, month, day, string_agg(minute || ',' || cell_id, '!' ORDER BY minute))
FROM test_points GROUP BY {DAY}
UNION ALL SELECT 'reject', bad FROM raw WHERE reason IS NOT NULL""",
        ),
        "day_vectors_rejects": _with(FILLED + "," + _damaged(VEC, "filled"), _REJECTS.format(six="'wrong number of slots'", four="'malformed cell'")),
        "test_sequences_rejects": _with(
            TEST_POINTS + "," + _damaged("string_agg(minute || ',' || cell_id, '!' ORDER BY minute)", "test_points"),
            _REJECTS.format(six="'malformed point'", four="'malformed point'"),
        ),
        "train_job_one_user": _with(
            kmeans, f"SELECT user_id::VARCHAR AS user_id, cluster_id, slot, rank, cell_id, freq, prob, interval_minutes FROM model WHERE user_id = {USER}"
        ),
    }
