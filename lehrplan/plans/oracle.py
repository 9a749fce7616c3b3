"""SQL counterparts of the registered queries, written independently of the DataFrame code."""

from __future__ import annotations

SO = """so AS (
  SELECT o_orderkey AS index, o_orderpriority AS class, o_totalprice AS total_price,
         line_count, sum_qty, avg_discount, avg_tax
  FROM orders LEFT JOIN (
    SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS line_count, sum(l_quantity) AS sum_qty,
           CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE)
             / (CAST(count(*) AS DOUBLE) * 100) AS avg_discount,
           CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE)
             / (CAST(count(*) AS DOUBLE) * 100) AS avg_tax
    FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)"""
METRICS = ["total_price", "line_count", "sum_qty", "avg_discount", "avg_tax"]
BATCH = """CAST(pos // {n} AS INTEGER) AS batch_idx, CAST(pos % {n} AS INTEGER) AS pos_in_batch"""


def rank(key: str, source: str = "so", ctes: str = SO) -> str:
    return (f"WITH {ctes} SELECT index, row_number() OVER (ORDER BY {key}, index) - 1 AS position "
            f"FROM {source}")


def batches(key: str, n: int, source: str = "so", ctes: str = SO) -> str:
    return (f"WITH {ctes}, r AS (SELECT index, row_number() OVER (ORDER BY {key}, index) - 1 AS "
            f"pos FROM {source}) SELECT {BATCH.format(n=n)}, index FROM r")


def minmax(metrics: list[str], inverted: tuple[str, ...] = ()) -> str:
    def scaled(m: str) -> str:
        v = (f"CASE WHEN max({m}) OVER () - min({m}) OVER () < 1e-10 THEN 0.0::DOUBLE ELSE "
             f"({m} - min({m}) OVER ()) / (max({m}) OVER () - min({m}) OVER ()) END")
        return f"1.0::DOUBLE - {v}" if m in inverted else v
    return ", ".join(f"{scaled(m)} AS {m}" for m in metrics)


def row_mean(metrics: list[str]) -> str:
    total = " + ".join(f"coalesce({m}, 0.0::DOUBLE)" for m in metrics)
    count = " + ".join(f"CAST({m} IS NOT NULL AS INTEGER)" for m in metrics)
    return f"({total}) / CAST(nullif({count}, 0) AS DOUBLE)"


def distributions(source: str, ctes: str, metrics: list[str], digits: int = 5) -> str:
    long = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, class, CAST({m} AS DOUBLE) AS v FROM {source}" for m in metrics)
    q = lambda p: f"round(quantile_cont(v, {p}), {digits})"
    body = (f"count(v) AS count, round(avg(v), {digits}) AS mean, round(max(v), {digits}) AS maximum,"
            f" {q(0.5)} AS median, round(min(v), {digits}) AS minimum,"
            f" round(stddev_samp(v), {digits}) AS std, {q(0.25)} AS p25, {q(0.5)} AS p50,"
            f" {q(0.75)} AS p75")
    return (f"WITH {ctes}, long AS ({long}) SELECT metric, 'global' AS scope, {body} FROM long "
            f"GROUP BY metric UNION ALL SELECT metric, class AS scope, {body} FROM long "
            f"WHERE class IS NOT NULL GROUP BY metric, class")


def unit_vectors(partition: str = "") -> str:
    """x0..x4: min-max scaled, centred, normalised rows of so (or chunks)."""
    over = f"OVER ({partition})"
    scaled = ", ".join(
        f"({m} - min({m}) {over}) / CASE WHEN max({m}) {over} - min({m}) {over} < 1e-10 THEN "
        f"1.0::DOUBLE ELSE max({m}) {over} - min({m}) {over} END AS s{i}"
        for i, m in enumerate(METRICS))
    mean = "(" + " + ".join(f"s{i}" for i in range(5)) + ") / 5.0::DOUBLE"
    centred = ", ".join(f"s{i} - mu AS c{i}" for i in range(5))
    norm = "sqrt(" + " + ".join(f"c{i} * c{i}" for i in range(5)) + ")"
    unit = ", ".join(f"c{i} / CASE WHEN nm < 1e-10 THEN 1.0::DOUBLE ELSE nm END AS x{i}"
                     for i in range(5))
    return (f"s AS (SELECT *, {scaled} FROM base), m AS (SELECT *, {mean} AS mu FROM s), "
            f"c AS (SELECT *, {centred} FROM m), n AS (SELECT *, {norm} AS nm FROM c), "
            f"u AS (SELECT *, {unit} FROM n)")


def votes(dimensions: int = 5) -> str:
    """Weights after all pairs of a chunk, one pair of every chunk a step: ``done`` from ``drawn``
    (u with the row number ``rn`` in its chunk)."""
    unit = ", ".join(f"x{i}" for i in range(dimensions))
    dot = " + ".join(f"x[i][{k}] * x[j][{k}]" for k in range(1, dimensions + 1))
    turn = """CASE WHEN wi >= 0 AND wj < 0 THEN {a} WHEN wi < 0 AND wj >= 0 THEN {b}
        WHEN p >= 0 THEN CASE WHEN wi >= 0 THEN p ELSE -p END WHEN wi < wj THEN {b} ELSE {a} END"""
    return f"""chunk AS MATERIALIZED (SELECT batch_idx, count(*) AS n, list([{unit}] ORDER BY rn) AS x,
      list(index ORDER BY rn) AS ids FROM drawn GROUP BY batch_idx),
    vote(batch_idx, i, j, w) AS (
      SELECT batch_idx, 1, 2, list_transform(ids, lambda k: 0.0::DOUBLE) FROM chunk WHERE n > 1
      UNION ALL
      SELECT batch_idx, CASE WHEN j < n THEN i ELSE i + 1 END, CASE WHEN j < n THEN j + 1 ELSE i + 2 END,
        list_transform(w, lambda v, k: CASE WHEN k = i THEN v + {turn.format(a="-p", b="p")}
          WHEN k = j THEN v + {turn.format(a="p", b="-p")} ELSE v END)
      FROM (SELECT batch_idx, n, i, j, w, w[i] AS wi, w[j] AS wj, coalesce({dot}, 0) AS p
            FROM vote JOIN chunk USING (batch_idx) WHERE i < n)),
    done AS (
      SELECT batch_idx, unnest(ids) AS index, unnest(w) AS weight
      FROM vote JOIN chunk USING (batch_idx) WHERE i = n
      UNION ALL SELECT batch_idx, ids[1], 0.0::DOUBLE FROM chunk WHERE n = 1)"""


SUPPLIERS = """base AS (SELECT s_suppkey AS index, s_acctbal AS total_price, line_count, sum_qty,
    avg_discount, avg_tax, 0 AS batch_idx FROM supplier LEFT JOIN (
    SELECT l_suppkey, count(*)::DOUBLE AS line_count, sum(l_quantity) AS sum_qty,
      CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100.0::DOUBLE) AS avg_discount,
      CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100.0::DOUBLE) AS avg_tax
    FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey)"""

PX = """px AS (SELECT vec_id AS index, label, unnest(embedding) AS v,
  generate_subscripts(embedding, 1) - 1 AS p FROM embeddings)"""
IMG = PX + """, img AS (SELECT index, CAST(p // 8 AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS x,
  CAST(v AS DOUBLE) AS v FROM px)"""
RGB = PX + """, rgb AS (SELECT index, ch, CAST(q // 8 AS INTEGER) AS y, CAST(q % 8 AS INTEGER) AS x,
  CAST(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CAST(v AS DOUBLE) + 0.5::DOUBLE)) AS FLOAT) AS v
  FROM (SELECT index, v, 0 AS ch, p AS q FROM px UNION ALL SELECT index, v, 1, 63 - p FROM px
        UNION ALL SELECT index, v, 2, (p + 43) % 64 FROM px))"""
RGB_U8 = RGB + """, u8 AS (SELECT index, ch, y, x, CAST(trunc(greatest(0.0::FLOAT,
  least(255.0::FLOAT, v * 255.0::FLOAT))) AS INTEGER) AS v FROM rgb)"""
RGB_VAR = """vars AS (SELECT index, ch, var_samp(CAST(v AS DOUBLE)) AS value FROM rgb
  GROUP BY index, ch)"""
RGB_GRAY = """gray AS (SELECT index, y, x, avg(CAST(v AS DOUBLE)) AS v FROM rgb
  GROUP BY index, y, x)"""


def frequency(source: str) -> str:
    return f"""steps AS (SELECT index,
    lead(v) OVER (PARTITION BY index, x ORDER BY y) - v AS dy,
    lead(v) OVER (PARTITION BY index, y ORDER BY x) - v AS dx FROM {source}),
  freq AS (SELECT index, sqrt(avg(dy * dy)) AS row_frequency, sqrt(avg(dx * dx)) AS
    column_frequency FROM steps GROUP BY index)"""


# 2x2 blocks of the plane below: approximation and the three details of one Haar level
HAAR = IMG + "".join(f""", h{k} AS (SELECT index, y // 2 AS y, x // 2 AS x,
    sum(v) / 2 AS v,
    pow(sum(v * (1 - 2 * (x % 2))) / 2, 2) + pow(sum(v * (1 - 2 * (y % 2))) / 2, 2)
      + pow(sum(v * (1 - 2 * (x % 2)) * (1 - 2 * (y % 2))) / 2, 2) AS e
    FROM {src} GROUP BY index, y // 2, x // 2)""" for k, src in ((1, "img"), (2, "h1"), (3, "h2")))
HAAR += ", lev AS (" + " UNION ALL ".join(
    f"SELECT index, {3 - k} AS level, sum(e) AS energy FROM h{k} GROUP BY index"
    for k in (1, 2, 3)) + ")"

# one db2 level of 8 values: out[i] = sum_j f[j] x[2i + 1 - j], mirrored at both ends
DB2 = IMG + """, taps AS (SELECT * FROM (VALUES
    (0, (1 - sqrt(3.0)) / (4 * sqrt(2.0)), -(1 + sqrt(3.0)) / (4 * sqrt(2.0))),
    (1, (3 - sqrt(3.0)) / (4 * sqrt(2.0)), (3 + sqrt(3.0)) / (4 * sqrt(2.0))),
    (2, (3 + sqrt(3.0)) / (4 * sqrt(2.0)), -(3 - sqrt(3.0)) / (4 * sqrt(2.0))),
    (3, (1 + sqrt(3.0)) / (4 * sqrt(2.0)), (1 - sqrt(3.0)) / (4 * sqrt(2.0)))) t(j, lo, hi)),
  band AS (SELECT i, CASE WHEN 2 * i + 1 - j < 0 THEN -(2 * i + 1 - j) - 1
      WHEN 2 * i + 1 - j > 7 THEN 15 - (2 * i + 1 - j) ELSE 2 * i + 1 - j END AS k, lo, hi
    FROM taps, range(5) r(i)),
  wide AS (SELECT index, y, i, sum(v * lo) AS l, sum(v * hi) AS h
    FROM img JOIN band ON k = x GROUP BY index, y, i),
  bands AS (SELECT index, w.i AS a, b.i AS b, sum(l * hi) AS lh, sum(h * lo) AS hl,
    sum(h * hi) AS hh FROM (SELECT index, y, i, l, h FROM wide) w
    JOIN band b ON b.k = w.y GROUP BY index, w.i, b.i)"""

SHIFT = PX + """, img AS (SELECT index, CAST(p // 8 AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS x,
  CAST(trunc(CAST(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CAST(v AS DOUBLE) * 2 + 0.5::DOUBLE))
    AS FLOAT) * 255.0::FLOAT) AS INTEGER) AS v FROM px),
  line AS (SELECT index, y, x, coalesce(lead(v) OVER w, v) - coalesce(lag(v) OVER w, v) AS d,
    coalesce(lag(v) OVER w, v) + 2 * v + coalesce(lead(v) OVER w, v) AS s
    FROM img WINDOW w AS (PARTITION BY index, y ORDER BY x)),
  sob AS (SELECT index, y, x,
    CAST(coalesce(lag(d) OVER w, d) + 2 * d + coalesce(lead(d) OVER w, d) AS INTEGER) AS gx,
    CAST(coalesce(lead(s) OVER w, s) - coalesce(lag(s) OVER w, s) AS INTEGER) AS gy
    FROM line WINDOW w AS (PARTITION BY index, x ORDER BY y)),
  mag AS (SELECT *, abs(gx) + abs(gy) AS m FROM sob)"""
# neighbours outside the image count as 0
EDGES = SHIFT + """, nb AS (SELECT a.index, a.y, a.x, any_value(a.gx) AS gx, any_value(a.gy) AS gy,
    any_value(a.m) AS m,
    coalesce(max(b.m) FILTER (b.y = a.y AND b.x = a.x - 1), 0) AS w,
    coalesce(max(b.m) FILTER (b.y = a.y AND b.x = a.x + 1), 0) AS e,
    coalesce(max(b.m) FILTER (b.y = a.y - 1 AND b.x = a.x), 0) AS n,
    coalesce(max(b.m) FILTER (b.y = a.y + 1 AND b.x = a.x), 0) AS s,
    coalesce(max(b.m) FILTER (b.y = a.y - 1 AND b.x = a.x - 1), 0) AS nw,
    coalesce(max(b.m) FILTER (b.y = a.y + 1 AND b.x = a.x + 1), 0) AS se,
    coalesce(max(b.m) FILTER (b.y = a.y - 1 AND b.x = a.x + 1), 0) AS ne,
    coalesce(max(b.m) FILTER (b.y = a.y + 1 AND b.x = a.x - 1), 0) AS sw
    FROM mag a JOIN mag b ON a.index = b.index AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1
    GROUP BY a.index, a.y, a.x),
  weak AS (SELECT index, y, x, m FROM nb WHERE m > 100 AND CASE
    WHEN abs(gy) < tan(pi() / 8) * abs(gx) THEN m > w AND m >= e
    WHEN abs(gy) > tan(3 * pi() / 8) * abs(gx) THEN m > n AND m >= s
    WHEN (gx < 0) <> (gy < 0) THEN m > ne AND m > sw ELSE m > nw AND m > se END),
  edge AS (SELECT index, y, x FROM weak WHERE m > 200
    UNION SELECT k.index, k.y, k.x FROM edge e JOIN weak k ON k.index = e.index
    AND abs(k.y - e.y) <= 1 AND abs(k.x - e.x) <= 1)"""


def edges(low: int, high: int) -> str:
    return EDGES.replace("m > 100", f"m > {low}").replace("m > 200", f"m > {high}")


DENSITY = """dens AS (SELECT v.vec_id AS index, count(e.index) / 64.0::DOUBLE AS edge_density,
  any_value(v.label) AS label FROM embeddings v LEFT JOIN edge e ON e.index = v.vec_id
  GROUP BY v.vec_id)"""
OBJECTS = """grown AS (SELECT DISTINCT i.index, i.y, i.x, i.y * 8 + i.x AS id FROM img i JOIN edge e
    ON e.index = i.index AND abs(e.y - i.y) <= 1 AND abs(e.x - i.x) <= 1),
  reach AS (SELECT index, y, x, id FROM grown
    UNION SELECT g.index, g.y, g.x, r.id FROM reach r JOIN grown g ON g.index = r.index
    AND abs(g.y - r.y) <= 1 AND abs(g.x - r.x) <= 1),
  objs AS (SELECT index, count(DISTINCT low) AS n FROM (SELECT index, y, x, min(id) AS low
    FROM reach GROUP BY index, y, x) GROUP BY index),
  cnt AS (SELECT v.vec_id AS index, CAST(coalesce(n, 0) AS DOUBLE) AS object_count
    FROM embeddings v LEFT JOIN objs ON objs.index = v.vec_id)"""

BOARD = """spec AS (SELECT p_partkey AS index, [1, 2, 4, 8][CAST(p_size % 4 + 1 AS INTEGER)] AS tiles,
    [CAST(p_partkey * 3 % 256 AS INTEGER), CAST(p_partkey * 5 % 256 AS INTEGER),
     CAST(p_partkey * 7 % 256 AS INTEGER)] AS a,
    [CAST((p_partkey * 3 + 100) % 256 AS INTEGER), CAST((p_partkey * 5 + 100) % 256 AS INTEGER),
     CAST((p_partkey * 7 + 100) % 256 AS INTEGER)] AS b FROM part),
  cell AS (SELECT index, ch, y, x, CASE WHEN (y // (8 // tiles) + x // (8 // tiles)) % 2 = 1
    THEN a[CAST(ch + 1 AS INTEGER)] ELSE {other}[CAST(ch + 1 AS INTEGER)] END AS v
    FROM spec, range(3) c(ch), range(8) r(y), range(8) k(x))
SELECT index, CAST(ch AS INTEGER) AS ch, CAST(sum(v) AS BIGINT) AS total,
  CAST(sum(v * (y * 8 + x + 1)) AS BIGINT) AS weighted FROM cell GROUP BY index, ch"""

HIST = """hist AS (SELECT user_id AS index, value AS loss, CAST(row_number() OVER (
  PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS iteration FROM events),
  cut AS (SELECT *, abs(loss - lag(loss) OVER (PARTITION BY index ORDER BY iteration)) AS delta
  FROM hist WHERE iteration <= 1000)"""
ONE = """one AS (SELECT CAST(0 AS BIGINT) AS index, value AS loss, row_number() OVER (ORDER BY ts, event_id) - 1
    AS iteration FROM events),
  cut AS (SELECT *, abs(loss - lag(loss) OVER (ORDER BY iteration)) AS delta FROM one)"""
LAYERS = """cut AS (SELECT * FROM (SELECT user_id AS index, event_type AS layer, value AS delta,
  CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS INTEGER)
  AS iteration FROM events) WHERE iteration <= 1000)"""


def islands(keys: str, threshold: float, source: str = "cut", delta: str = "delta") -> str:
    return f"""isl AS (SELECT *, coalesce(sum(CAST({delta} IS NULL OR {delta} >= {threshold} AS
    INTEGER)) OVER (PARTITION BY {keys} ORDER BY iteration), 0) AS island FROM {source}),
  st AS (SELECT *, CAST(sum(CAST({delta} IS NOT NULL AND {delta} < {threshold} AS INTEGER)) OVER (
    PARTITION BY {keys}, island ORDER BY iteration) AS INTEGER) AS stable_run FROM isl)"""


LAYER_SAT = f"""{LAYERS}, {islands('index, layer', 60)},
  sat AS (SELECT index, layer, min(iteration) FILTER (stable_run >= 3) AS completed,
    max(iteration) AS last FROM st GROUP BY index, layer)"""

SIG = """sig AS (SELECT event_type AS run, CAST(day(ts) AS INTEGER) AS epoch,
    CAST(user_id % 10 AS INTEGER) AS batch_idx,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100.0::DOUBLE)
      AS mean_std,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 1000.0::DOUBLE)
      AS mean_grad_norm,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 10000.0::DOUBLE)
      AS mean_entropy
    FROM events GROUP BY 1, 2, 3)"""
EPO = """epo AS (SELECT event_type AS run, CAST(day(ts) AS INTEGER) AS epoch,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 10000.0::DOUBLE)
      AS train_loss,
    count(*) FILTER (value > 50) / CAST(count(*) AS DOUBLE) AS train_acc,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 8000.0::DOUBLE)
      AS val_loss,
    count(*) FILTER (value > 40) / CAST(count(*) AS DOUBLE) AS val_acc,
    CAST(count(DISTINCT user_id % 10) AS INTEGER) AS batches FROM events GROUP BY 1, 2)"""


def runs(batch_size: int) -> str:
    return (f"runs AS (SELECT event_type AS run, CAST(ceil(count(*) / {batch_size}.0::DOUBLE) AS "
            "INTEGER) AS total_batches FROM events GROUP BY 1)")


LINEAR = """lin AS (SELECT run, CAST(e AS INTEGER) AS epoch, CAST(CASE WHEN e >= {full} THEN
    total_batches ELSE greatest(1, CAST(trunc(({f0}::DOUBLE + {rest}::DOUBLE * (e / {full}.0::DOUBLE))
    * total_batches) AS BIGINT)) END AS INTEGER) AS n_active
  FROM runs, range(1, 31) r(e))"""
LINEAR_03 = LINEAR.format(full=18, f0="0.3", rest="0.7")

LOSS_SIGNAL = """ls AS (SELECT run, epoch, CASE WHEN n < 10 THEN 0.0::DOUBLE WHEN prior < 1e-8 THEN
    1.0::DOUBLE ELSE 1 / (1 + exp(-10 * (recent - prior) / prior)) END AS signal FROM (
    SELECT run, epoch, row_number() OVER w AS n,
      avg(train_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN 9 PRECEDING AND 5
        PRECEDING) AS prior,
      avg(train_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN 4 PRECEDING AND CURRENT
        ROW) AS recent
    FROM epo WINDOW w AS (PARTITION BY run ORDER BY epoch)))"""
VAL_SIGNAL = """vs AS (SELECT run, epoch, CASE WHEN n < 5 THEN 0.0::DOUBLE WHEN sd < 1e-8 THEN
    1.0::DOUBLE ELSE 1 / (1 + exp(5 * slope / sd)) END AS signal FROM (
    SELECT run, epoch, n, regr_slope(val_acc, n) OVER w AS slope, stddev_pop(val_acc) OVER w AS sd
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY run ORDER BY epoch) AS DOUBLE) AS n
          FROM epo) WINDOW w AS (PARTITION BY run ORDER BY epoch ROWS BETWEEN 4 PRECEDING AND
          CURRENT ROW)))"""


def plateau(name: str, value: str, window: int = 5) -> str:
    return f"""{name} AS (SELECT run, batch_idx, epoch,
    CASE WHEN n < {window + 2} THEN false WHEN cvf < 1e-8 THEN true ELSE cvr / cvf < 0.25 END
      AS is_plateau,
    CASE WHEN n < {window + 2} THEN 0.0::DOUBLE WHEN cvf < 1e-8 THEN 1.0::DOUBLE
      ELSE greatest(0.0::DOUBLE, 1 - cvr / cvf) END AS stability FROM (
    SELECT run, batch_idx, epoch, row_number() OVER f AS n,
      stddev_pop({value}) OVER r / (abs(avg({value}) OVER r) + 1e-8) AS cvr,
      stddev_pop({value}) OVER f / (abs(avg({value}) OVER f) + 1e-8) AS cvf FROM sig
    WINDOW f AS (PARTITION BY run, batch_idx ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND
        CURRENT ROW),
      r AS (PARTITION BY run, batch_idx ORDER BY epoch ROWS BETWEEN {window - 1} PRECEDING AND
        CURRENT ROW)))"""


def carried(name: str, source: str) -> str:
    """Mean over batches of the last stability known at each epoch."""
    return f"""{name} AS (SELECT run, epoch, avg(s) AS signal FROM (
    SELECT e.run, e.epoch, b.batch_idx, last_value(p.stability IGNORE NULLS) OVER (
      PARTITION BY e.run, b.batch_idx ORDER BY e.epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT
      ROW) AS s
    FROM (SELECT DISTINCT run, epoch FROM sig) e
    JOIN (SELECT DISTINCT run, batch_idx FROM sig) b ON b.run = e.run
    LEFT JOIN {source} p ON p.run = e.run AND p.epoch = e.epoch AND p.batch_idx = b.batch_idx)
    GROUP BY run, epoch)"""


READY = f"""{SIG}, {EPO}, {LOSS_SIGNAL}, {VAL_SIGNAL}, {plateau('ps', 'mean_std')},
  {plateau('pg', 'mean_grad_norm')}, {carried('act', 'ps')}, {carried('grd', 'pg')},
  ready AS (SELECT run, epoch, coalesce(ls.signal, 0) AS r_loss, coalesce(vs.signal, 0) AS r_val,
    coalesce(act.signal, 0) AS r_act, coalesce(grd.signal, 0) AS r_grad,
    (coalesce(ls.signal, 0) + coalesce(vs.signal, 0) + coalesce(act.signal, 0)
     + coalesce(grd.signal, 0)) / 4 AS readiness
    FROM epo LEFT JOIN ls USING (run, epoch) LEFT JOIN vs USING (run, epoch)
    LEFT JOIN act USING (run, epoch) LEFT JOIN grd USING (run, epoch))"""


def adaptive(runs_table: str) -> str:
    return f"""WITH RECURSIVE {READY}, {runs_table},
  pace AS (SELECT run, 0 AS epoch, greatest(1, CAST(trunc(total_batches * 0.3::DOUBLE) AS BIGINT))
      AS active FROM runs
    UNION ALL
    SELECT run, epoch, CASE WHEN rest <= 0 THEN active + rest ELSE active + greatest(1, least(
      CAST(trunc(low + readiness * (least(rest, 3 * low) - low)) AS BIGINT), rest)) END
    FROM (SELECT r.run, r.epoch, p.active, r.readiness, n.total_batches - p.active AS rest,
        CASE WHEN 30 - r.epoch > 0 THEN greatest(1, CAST(ceil((n.total_batches - p.active)
          / CAST(30 - r.epoch AS DOUBLE)) AS BIGINT)) ELSE n.total_batches - p.active END AS low
      FROM pace p JOIN ready r ON r.run = p.run AND r.epoch = p.epoch + 1
      JOIN runs n ON n.run = p.run))"""


ADAPTIVE = f"""{adaptive(runs(8))} SELECT run, CAST(epoch AS INTEGER) AS epoch,
    CAST(active AS INTEGER) AS n_active FROM pace WHERE epoch > 0"""


def means(value: str, where: str = "true") -> str:
    return f"""{SIG}, met AS (SELECT * FROM sig WHERE {where}), {runs(200)}, grid AS (SELECT run, CAST(e AS INTEGER) AS epoch,
      CAST(b AS INTEGER) AS batch_idx FROM runs, range(1, 31) r(e), range(100000) k(b)
      WHERE b < total_batches),
    means AS (SELECT run, epoch, batch_idx, coalesce(avg({value}) OVER (PARTITION BY run, batch_idx
      ORDER BY epoch), 0) AS mean FROM grid LEFT JOIN met USING (run, epoch, batch_idx))"""


def smoothed(half: int) -> str:
    return f"""sm AS (SELECT *, avg(mean) OVER (PARTITION BY run, epoch ORDER BY batch_idx ROWS
      BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS smooth FROM means)"""


def signal_order(value: str, half: int, cold: int, where: str = "true") -> str:
    return f"""WITH {means(value, where)}, {smoothed(half)}
  SELECT run, epoch, CAST(row_number() OVER (PARTITION BY run, epoch ORDER BY
    CASE WHEN epoch <= {cold} THEN 0 ELSE round(smooth, 9) END DESC, batch_idx) - 1 AS INTEGER)
    AS slot, batch_idx FROM sm"""


def streamed_order(value: str, half: int, cold: int) -> str:
    """Without the reports that come too late, for the epochs that have others."""
    order = signal_order(value, half, cold, "NOT (batch_idx % 5 = 3 AND (epoch - 1) % 10 < 8)")
    return f"{order} WHERE (run, epoch) IN (SELECT (run, epoch) FROM met)"


LOGITS = """lg AS (SELECT vec_id AS index, label, vec_id // 32 AS batch_idx,
    unnest(embedding)::DOUBLE AS z, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
  nrm AS (SELECT index, max(z) AS top, ln(sum(exp(z))) AS lse FROM lg GROUP BY index),
  smp AS (SELECT lg.index, any_value(batch_idx) AS batch_idx, any_value(label) AS label,
    any_value(lse) - max(z) FILTER (k = label) AS cross_entropy,
    CAST(min(k) FILTER (z = top) AS INTEGER) AS predicted,
    -sum(exp(z - lse) * (z - lse)) AS entropy
    FROM lg JOIN nrm ON nrm.index = lg.index GROUP BY lg.index)"""
LAYER_VALUES = """lv AS (SELECT l_returnflag AS run, CAST(month(l_shipdate) AS INTEGER) AS epoch,
    CAST(l_suppkey % 10 AS INTEGER) AS batch_idx, l_linenumber AS layer, l_quantity AS v
    FROM lineitem),
  per AS (SELECT run, epoch, batch_idx, layer, stddev_samp(v) AS s, sqrt(sum(v * v)) AS n
    FROM lv GROUP BY ALL)"""

BEST = """best AS (SELECT run, epoch AS best_epoch, val_acc AS best_accuracy, val_loss AS best_loss
    FROM epo QUALIFY row_number() OVER (PARTITION BY run ORDER BY val_acc DESC, epoch) = 1)"""
FINAL = """fin AS (SELECT run, train_acc AS final_train_accuracy, train_loss AS final_train_loss,
    val_acc AS final_val_accuracy, val_loss AS final_val_loss FROM epo
    QUALIFY row_number() OVER (PARTITION BY run ORDER BY epoch DESC) = 1)"""
USED = """used AS (SELECT run, CAST(sum(batches) AS BIGINT) AS total_batches_processed,
    round(1 - sum(batches) / (10.0::DOUBLE * 30), 4) AS dsi FROM epo GROUP BY run)"""
CONFIG = """cfg AS (SELECT DISTINCT event_type AS run, 'net' AS network,
    event_type = 'view' AS shuffled, event_type NOT IN ('click', 'view') AS paced FROM events),
  hsh AS (SELECT *, md5('{"dataset":"events","device":"cpu","epochs":30,"metric":'
    || CASE WHEN paced THEN '"metric-' || run || '"' ELSE 'null' END || ',"network":"net",'
    || '"normalize_classes":false,"rank":' || CASE WHEN paced THEN '"ascending"' ELSE 'null' END
    || ',"schedule":' || CASE WHEN paced THEN '"linear"' ELSE 'null' END || ',"scope":'
    || CASE WHEN paced THEN '"holistic"' ELSE 'null' END || ',"seed":1,"shuffled":'
    || CAST(shuffled AS VARCHAR) || ',"start_fraction":0.3}') AS hash FROM cfg)"""
RECORDS = f"{EPO}, {BEST}, {FINAL}, {USED}, {CONFIG}"

PART64 = """pb AS (SELECT p_partkey AS index, row_number() OVER (ORDER BY {key}, p_partkey) - 1 AS pos
  FROM part)"""

ORACLE: dict[str, str] = {
    # ranks
    "rank_ascending": rank("total_price"),
    "rank_descending": rank("avg_tax DESC NULLS LAST"),
    "rank_ascending_ties": "SELECT p_partkey AS index, row_number() OVER (ORDER BY p_size, "
                           "p_partkey) - 1 AS position FROM part",
    "rank_distance_from_mean": rank("abs(total_price - (SELECT avg(total_price) FROM so))"),
    "rank_by_class": f"""WITH {SO}, k AS (SELECT index, class, abs(total_price - avg(total_price)
        OVER (PARTITION BY class)) AS k FROM so)
      SELECT class, index, row_number() OVER (PARTITION BY class ORDER BY k, index) - 1 AS position
      FROM k""",
    "rank_lexicographic": rank("line_count NULLS LAST, avg_discount NULLS LAST, total_price"),
    "rank_normalized_mean": rank(
        f"{row_mean(METRICS)} NULLS LAST", "mm",
        f"{SO}, mm AS (SELECT index, {minmax(METRICS, ('avg_tax',))} FROM so)"),
    "rank_weighted": rank(
        "k NULLS LAST", "w", f"""{SO}, r AS (SELECT {", ".join(
            f"abs(corr({m}, total_price)) AS r_{m}" for m in METRICS[1:])} FROM so),
        w AS (SELECT index, round((total_price - avg(total_price) OVER ()) / stddev_samp(total_price)
          OVER () + ({" + ".join(
              f"coalesce(r_{m} / ({' + '.join(f'r_{n}' for n in METRICS[1:])}) * (({m} - avg({m}) "
              f"OVER ()) / stddev_samp({m}) OVER ()), 0)" for m in METRICS[1:])}), 9) AS k
          FROM so, r)"""),
    "rank_correlation_sum": rank(
        "k", "v", f"""{SO}, base AS (SELECT * FROM so), {unit_vectors()},
        v AS (SELECT index, round(coalesce({" + ".join(
            f"x{i} * sum(x{i}) OVER ()" for i in range(5))} - ({" + ".join(
                f"x{i} * x{i}" for i in range(5))}), 0), 6) AS k FROM u)"""),
    "rank_topk": f"WITH {SO} SELECT index FROM so ORDER BY total_price NULLS LAST, index LIMIT 128",
    "rank_lineitem": """WITH r AS (SELECT l_extendedprice AS p, row_number() OVER (ORDER BY
        l_extendedprice) - 1 AS pos FROM lineitem)
      SELECT CAST(pos // 128 AS INTEGER) AS batch_idx, count(*) AS samples, min(p) AS first,
        max(p) AS last FROM r GROUP BY 1""",
    "rank_cached": rank("sum_qty NULLS LAST"),
    "rank_cached_after_crash": rank("sum_qty NULLS LAST"),
    # statistics
    "metric_distributions": distributions("so", SO, METRICS),
    "metric_distributions_part": distributions(
        "p", "p AS (SELECT p_brand AS class, p_size, p_retailprice FROM part)",
        ["p_size", "p_retailprice"]),
    "metric_distributions_documents": distributions(
        "dl", "dl AS (SELECT lang AS class, n_chars, quality, toxic FROM documents LEFT JOIN "
              "labels USING (doc_id))", ["n_chars", "quality", "toxic"]),
    "unique_classes": f"WITH {SO} SELECT DISTINCT class FROM so",
    "column_statistics": f"WITH {SO} " + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round(avg({m}), 5) AS mean, round(min({m}), 5) AS minimum, "
        f"round(max({m}), 5) AS maximum, round(max({m}) - min({m}), 5) AS range, "
        f"max({m}) - min({m}) < 1e-10 AS constant FROM so" for m in METRICS),
    "distance_from_mean_key": f"WITH {SO} SELECT index, round(abs(total_price - (SELECT "
                              "avg(total_price) FROM so)), 4) AS key FROM so",
    "minmax_normalize": f"WITH {SO}, mm AS (SELECT index, {minmax(METRICS)} FROM so) SELECT index, "
                        + ", ".join(f"round({m}, 6) AS {m}" for m in METRICS) + " FROM mm",
    "zscore_normalize": f"WITH {SO} SELECT index, " + ", ".join(
        f"round(({m} - avg({m}) OVER ()) / stddev_samp({m}) OVER (), 6) + 0.0::DOUBLE AS {m}"
        for m in METRICS) + " FROM so",
    "anchor_correlations": f"WITH {SO} " + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round(corr({m}, total_price), 8) AS correlation FROM so"
        for m in METRICS[1:]),
    # scopes
    "batches_holistic": batches("total_price", 128),
    "batches_batch_wise": f"""WITH {SO}, c AS (SELECT index, total_price, CAST((row_number() OVER (
        ORDER BY md5('7:' || index), index) - 1) // 128 AS INTEGER) AS batch_idx FROM so)
      SELECT batch_idx, CAST(row_number() OVER (PARTITION BY batch_idx ORDER BY total_price, index)
        - 1 AS INTEGER) AS pos_in_batch, index FROM c""",
    "batches_batch_wise_distance": """WITH c AS (SELECT p_partkey AS index, p_retailprice AS v,
        CAST((row_number() OVER (ORDER BY md5('7:' || p_partkey), p_partkey) - 1) // 64 AS INTEGER)
        AS batch_idx FROM part),
      k AS (SELECT *, abs(v - avg(v) OVER (PARTITION BY batch_idx)) AS k FROM c)
      SELECT batch_idx, CAST(row_number() OVER (PARTITION BY batch_idx ORDER BY k, index) - 1 AS
        INTEGER) AS pos_in_batch, index FROM k""",
    "batches_baseline": batches("index", 128),
    "batches_shuffled": batches("md5('3:' || index)", 128),
    "shuffle_positions": "SELECT p_partkey AS index, row_number() OVER (ORDER BY md5('11:' || "
                         "p_partkey), p_partkey) - 1 AS position FROM part",
    "batches_class_balanced": batches("share, class", 128, "f", f"""{SO}, f AS (SELECT index, class,
        row_number() OVER (PARTITION BY class ORDER BY total_price, index)
        / CAST(count(*) OVER (PARTITION BY class) AS DOUBLE) AS share FROM so)"""),
    "batches_coverage": f"WITH {SO} SELECT index, 'missing' AS problem FROM so WHERE line_count IS "
                        "NULL",
    "batch_samples": f"WITH {PART64.format(key='p_retailprice DESC')} SELECT "
                     f"{BATCH.format(n=64)}, index, p_brand AS class, p_retailprice FROM pb JOIN "
                     "part ON p_partkey = index",
    "curriculum_active": """WITH o AS (SELECT CAST(day(ts) AS INTEGER) AS epoch, event_id AS slot,
        CAST(CASE WHEN day(ts) % 7 = 0 THEN -1 ELSE user_id - 20 END AS INTEGER) AS batch_idx
        FROM events), n AS (SELECT CAST(ceil(count(*) / 64.0) AS INTEGER) AS total FROM part),
      ok AS (SELECT epoch, slot, batch_idx FROM o, n WHERE batch_idx >= 0 AND batch_idx < total)
      SELECT * FROM ok UNION ALL SELECT DISTINCT epoch, 0::BIGINT, 0 FROM o
      WHERE epoch NOT IN (SELECT epoch FROM ok)""",
    "curriculum_sequence": f"""WITH {PART64.format(key='p_retailprice')}, n AS (SELECT
        max(pos // 64) + 1 AS total FROM pb),
      act AS (SELECT e, CASE WHEN e = 1 OR e - 1 >= 3 THEN total ELSE greatest(1, CAST(trunc(
        (0.3::DOUBLE + 0.7::DOUBLE * ((e - 1) / 3.0::DOUBLE)) * total) AS BIGINT)) END AS active
        FROM n, range(1, 7) r(e))
      SELECT CAST(e AS INTEGER) AS epoch, pos AS position, index FROM act JOIN pb
      ON pos // 64 < active""",
    "curriculum_sequence_adaptive": f"""{adaptive("""runs AS (SELECT 'click' AS run,
          CAST(ceil(count(*) / 64.0::DOUBLE) AS INTEGER) AS total_batches FROM part)""")},
      {PART64.format(key='p_retailprice')},
      shown AS (SELECT 1 AS e, total_batches AS active FROM runs UNION ALL
        SELECT epoch + 1, active FROM pace WHERE epoch BETWEEN 1 AND 29)
      SELECT CAST(e AS INTEGER) AS epoch, pos AS position, index FROM shown JOIN pb
      ON pos // 64 < active""",
    "curriculum_sequence_logged": """WITH o AS (SELECT CAST(day(ts) AS INTEGER) AS epoch, event_id AS
        slot, CASE WHEN day(ts) % 7 = 0 THEN -1 ELSE user_id - 20 END AS b FROM events),
      pb AS (SELECT p_partkey AS index, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part),
      ok AS (SELECT * FROM o WHERE b >= 0 AND b <= (SELECT max(pos // 8) FROM pb)),
      act AS (SELECT * FROM ok UNION ALL SELECT DISTINCT epoch, 0, 0 FROM o
        WHERE epoch NOT IN (SELECT epoch FROM ok))
      SELECT epoch, row_number() OVER (PARTITION BY epoch ORDER BY slot, pos) - 1 AS position, index
      FROM act JOIN pb ON pos // 8 = b""",
    "curriculum_sequence_signals": f"""WITH {SIG}, {PART64.format(key='p_retailprice')},
      grid AS (SELECT CAST(e AS INTEGER) AS epoch, b AS batch_idx FROM range(1, 31) r(e),
        (SELECT DISTINCT pos // 192 AS b FROM pb)),
      top AS (SELECT epoch, batch_idx, max(mean_grad_norm) AS mean_grad_norm FROM sig GROUP BY ALL),
      means AS (SELECT g.epoch, g.batch_idx, coalesce(avg(mean_grad_norm) OVER (PARTITION BY
        g.batch_idx ORDER BY g.epoch), 0) AS mean FROM grid g LEFT JOIN top ON
        top.epoch = g.epoch AND top.batch_idx = g.batch_idx),
      sm AS (SELECT *, avg(mean) OVER (PARTITION BY epoch ORDER BY batch_idx ROWS BETWEEN 2 PRECEDING
        AND 2 FOLLOWING) AS smooth FROM means),
      ord AS (SELECT epoch + 1 AS epoch, batch_idx, row_number() OVER (PARTITION BY epoch ORDER BY
        CASE WHEN epoch <= 1 THEN 0 ELSE smooth END DESC, batch_idx) AS slot FROM sm
        UNION ALL SELECT 1, batch_idx, batch_idx FROM grid WHERE epoch = 1)
      SELECT epoch, row_number() OVER (PARTITION BY epoch ORDER BY slot, pos) - 1 AS position, index
      FROM ord JOIN pb ON pos // 192 = batch_idx WHERE epoch <= 30""",
    # score tables
    "scores_init": "SELECT o_orderkey AS index, NULL::VARCHAR AS class, NULL::DOUBLE AS "
                   "edge_density, NULL::DOUBLE AS color_variance FROM orders",
    "score_resume_after_crash": f"""WITH {SO} SELECT index, class, CASE WHEN index % 3 = 0 THEN
        total_price * 2 ELSE total_price END AS total_price, line_count FROM so""",
    "scores_load": f"WITH {SO} SELECT * FROM so",
    "score_select": f"WITH {SO} SELECT index, class, total_price, avg_tax FROM so",
    "score_get": "SELECT o_orderkey AS index, o_totalprice AS score FROM orders WHERE o_orderkey "
                 "= 77",
    "score_unscored": f"WITH {SO} SELECT index FROM so WHERE sum_qty IS NULL",
    "score_pending": "SELECT o_orderkey AS index, o_custkey FROM orders WHERE o_orderkey NOT IN "
                     "(SELECT l_orderkey FROM lineitem)",
    "score_upsert": f"""WITH {SO} SELECT index, class,
        CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE total_price END AS total_price,
        avg_tax, CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS DOUBLE) END AS customer
      FROM so JOIN orders ON o_orderkey = index""",
    "label_join": "SELECT label, vec_id, n_name AS class FROM embeddings LEFT JOIN nation ON "
                  "n_nationkey = label",
    "registry_filter": "SELECT p_partkey AS id FROM part WHERE list_contains(string_split(p_name, "
                       "' '), 'ring') AND p_type = 'ECONOMY'",
    "metrics_unknown": """SELECT DISTINCT w AS id FROM (SELECT unnest(string_split(p_name, ' ')) AS w
      FROM part UNION ALL SELECT p_brand FROM part) WHERE w NOT IN (SELECT p_brand FROM part)""",
    "curriculum_described": f"WITH {PART64.format(key='p_size DESC')} SELECT {BATCH.format(n=64)}, "
                            "index, 'descending' AS rank, 'p_size' AS metric, 'holistic' AS scope "
                            "FROM pb",
    # an 8x8 image padded by 4 is smaller than the 32x32 window, so every offset is 0
    "img_prepare": f"""WITH {RGB}, d AS (SELECT vec_id AS index,
        CAST(('0x' || substr(md5('9:flip:' || vec_id), 1, 8)) AS BIGINT) % 2 AS flip
        FROM embeddings),
      o AS (SELECT index, CAST(c AS INTEGER) AS ch, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x,
        y - 4 AS sy, CASE WHEN flip = 1 THEN 31 - x ELSE x END - 4 AS sx
        FROM d, range(3) r(c), range(32) s(y), range(32) t(x))
      SELECT o.index, o.ch, o.y, round(sum(z), 6) + 0.0::DOUBLE AS total,
        round(sum(z * o.x), 6) + 0.0::DOUBLE AS weighted FROM (SELECT o.*, CAST(CAST((coalesce(
        CAST(i.v AS DOUBLE), 0) - [0.4914, 0.4822, 0.4465][o.ch + 1]::DOUBLE)
        / [0.2023, 0.1994, 0.2010][o.ch + 1]::DOUBLE AS FLOAT) AS DOUBLE) AS z
      FROM o LEFT JOIN rgb i ON i.index = o.index AND i.ch = o.ch AND i.y = sy AND i.x = sx) o
      GROUP BY o.index, o.ch, o.y""",
    "score_report": """SELECT p_partkey AS index, '{"p_size":' || p_size || '}' AS report
      FROM part""",
    # images
    "corpus_facts": """SELECT CASE WHEN label % 5 = 0 THEN 'test' ELSE 'train' END AS split,
        count(*) AS size, CAST(count(DISTINCT label) AS INTEGER) AS num_classes, 1 AS channels,
        8 AS height, 8 AS width FROM embeddings GROUP BY 1""",
    "gen_checkerboard": "WITH " + BOARD.format(other="b"),
    "gen_solid": "WITH " + BOARD.format(other="a"),
    "img_scale": f"WITH {RGB_U8} SELECT index, ch, y, x, round(CAST(CAST(v AS FLOAT) / 255.0::FLOAT "
                 "AS DOUBLE), 6) AS v FROM u8",
    "img_normalize": f"""WITH {RGB} SELECT index, ch, y, x, round(CAST(CAST((CAST(v AS DOUBLE)
        - [0.4914, 0.4822, 0.4465][ch + 1]::DOUBLE) / [0.2023, 0.1994, 0.2010][ch + 1]::DOUBLE
        AS FLOAT) AS DOUBLE), 6) + 0.0::DOUBLE AS v FROM rgb""",
    "img_gray_mean": f"WITH {RGB}, {RGB_GRAY} SELECT index, y, x, round(v, 6) AS v FROM gray",
    "img_gray_luma": f"""WITH {RGB} SELECT index, y, x, round(CAST(CAST(sum(CAST(v AS DOUBLE)
        * [0.299, 0.587, 0.114][ch + 1]::DOUBLE) AS FLOAT) AS DOUBLE), 5) AS v FROM rgb
      GROUP BY index, y, x""",
    "img_to_u8": f"WITH {RGB_U8} SELECT * FROM u8",
    "img_augment": f"""WITH {IMG}, d AS (SELECT vec_id AS index,
        CAST(('0x' || substr(md5('5:dy:' || vec_id), 1, 8)) AS BIGINT) % 5 AS dy,
        CAST(('0x' || substr(md5('5:dx:' || vec_id), 1, 8)) AS BIGINT) % 5 AS dx,
        CAST(('0x' || substr(md5('5:flip:' || vec_id), 1, 8)) AS BIGINT) % 2 AS flip
        FROM embeddings),
      o AS (SELECT index, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, y + dy - 2 AS sy,
        CASE WHEN flip = 1 THEN 7 - x ELSE x END + dx - 2 AS sx FROM d, range(8) r(y), range(8) k(x))
      SELECT o.index, 0 AS ch, o.y, o.x, round(coalesce(i.v, 0.0::DOUBLE), 6) + 0.0::DOUBLE AS v
      FROM o LEFT JOIN img i ON i.index = o.index AND i.y = sy AND i.x = sx""",
    "m_color_variance": f"WITH {RGB}, {RGB_VAR} SELECT index, round(avg(value), 8) AS value FROM "
                        "vars GROUP BY index",
    "m_channel_variances": f"WITH {RGB}, {RGB_VAR} SELECT index, ch, round(value, 8) AS value FROM "
                           "vars",
    "m_spatial_frequency": f"""WITH {IMG}, {frequency('img')} SELECT index, round(sqrt(
        row_frequency * row_frequency + column_frequency * column_frequency), 8) AS value
        FROM freq""",
    "m_row_col_frequency": f"WITH {RGB}, {RGB_GRAY}, {frequency('gray')} SELECT index, "
                           "round(row_frequency, 8) AS row_frequency, round(column_frequency, 8) "
                           "AS column_frequency FROM freq",
    "m_wavelet_haar": f"""WITH {HAAR}, t AS (SELECT index, sum(energy) AS total FROM lev GROUP BY
        index) SELECT index, round(CASE WHEN any_value(total) < 1e-6 THEN 0 ELSE any_value(total)
        END, 8) AS energy, round(CASE WHEN any_value(total) < 1e-6 THEN 0 ELSE -sum(CASE WHEN
        energy > 0 THEN energy / total * log2(energy / total) ELSE 0 END) / log2(3) END, 8) AS
        entropy FROM lev JOIN t USING (index) GROUP BY index""",
    "m_wavelet_haar_levels": f"WITH {HAAR} SELECT index, CAST(level AS INTEGER) AS level, "
                             "round(energy, 8) AS energy FROM lev",
    "m_wavelet_db2": f"""WITH {DB2} SELECT index, round(sum(lh * lh + hl * hl + hh * hh), 8) AS
        energy, 0.0::DOUBLE AS entropy FROM bands GROUP BY index""",
    "m_sobel_magnitude": f"WITH {SHIFT} SELECT index, y, x, gx, gy, CAST(m AS INTEGER) AS magnitude "
                         "FROM mag",
    "m_edge_density": f"WITH RECURSIVE {EDGES}, {DENSITY} SELECT index, round(edge_density, 8) AS "
                      "edge_density FROM dens",
    "corpus_read": f"""WITH {RGB}, named AS (SELECT vec_id, CAST(label AS VARCHAR) AS class,
        CASE WHEN label % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM embeddings),
      places AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY class, vec_id) - 1 AS place
        FROM named)
      SELECT split, place AS index, class, CAST(sum(b) AS BIGINT) AS total,
        CAST(sum(b * (ch * 64 + y * 8 + x + 1)) AS BIGINT) AS weighted
      FROM (SELECT *, CAST(trunc(v * 255.0::FLOAT) AS BIGINT) AS b FROM rgb) p JOIN places ON p.index = vec_id
      GROUP BY ALL""",
    "m_edge_density_thresholds": f"""SELECT index, edge_density, object_count FROM (
      WITH RECURSIVE {edges(40, 90)}, {DENSITY} SELECT index, round(edge_density, 8) AS edge_density FROM dens)
      JOIN (WITH RECURSIVE {edges(150, 300)}, {OBJECTS} SELECT index, object_count FROM cnt) USING (index)""",
    "m_wavelet_levels_given": f"WITH {HAAR} SELECT index, CAST(level - 1 AS INTEGER) AS level, "
                              "round(energy, 8) AS energy FROM lev WHERE level > 0",
    "m_object_count": f"WITH RECURSIVE {EDGES}, {OBJECTS} SELECT index, object_count FROM cnt",
    "score_dataset": f"""WITH RECURSIVE {EDGES}, {DENSITY}, {OBJECTS}, vr AS (SELECT index,
        var_samp(CAST(CAST(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CAST(v AS DOUBLE) * 2
          + 0.5::DOUBLE)) AS FLOAT) AS DOUBLE)) AS cv FROM px GROUP BY index)
      SELECT index, CAST(label AS VARCHAR) AS class, round(edge_density, 8) AS edge_density,
        round(cv, 8) AS color_variance, object_count FROM dens JOIN vr USING (index)
        JOIN cnt USING (index)""",
    # histories
    "h_convergence_time": f"""WITH {HIST}, {islands('index', 40)} SELECT index,
        CAST(coalesce(min(iteration) FILTER (stable_run >= 5), max(iteration)) AS DOUBLE) AS value,
        count(*) FILTER (stable_run >= 5) > 0 AS converged,
        coalesce(arg_min(loss, iteration) FILTER (stable_run >= 5), arg_max(loss, iteration)) AS
        final_loss FROM st GROUP BY index""",
    "h_layer_saturation": f"WITH {LAYER_SAT} SELECT index, layer, coalesce(completed - 2, -1) AS "
                          "start, completed, last FROM sat",
    "h_saturation_time": f"""WITH {LAYER_SAT} SELECT index, CAST(CASE WHEN bool_and(completed IS
        NOT NULL) THEN max(completed) ELSE max(last) END AS DOUBLE) AS value,
        bool_and(completed IS NOT NULL) AS saturated FROM sat GROUP BY index""",
    "h_weight_delta": """WITH s AS (SELECT label, 'layer' || (vec_id % 4) AS layer, vec_id,
        CAST(row_number() OVER w - 1 AS INTEGER) AS iteration, embedding,
        lag(vec_id) OVER w AS before FROM embeddings
        WINDOW w AS (PARTITION BY label, vec_id % 4 ORDER BY vec_id)),
      e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k
        FROM embeddings)
      SELECT CAST(label AS BIGINT) AS index, layer, iteration,
        round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 6) AS delta
      FROM s JOIN e a ON a.vec_id = s.vec_id JOIN e b ON b.vec_id = s.before AND b.k = a.k
      WHERE iteration <= 1000 GROUP BY label, layer, iteration""",
    "h_histories": f"""WITH {HIST}, {islands('index', 40)}, z AS (SELECT index, loss, iteration,
        min(iteration) FILTER (stable_run >= 5) OVER (PARTITION BY index) AS stop FROM st)
      SELECT index, iteration - 1 AS step, round(loss, 6) AS loss FROM z
      WHERE iteration <= coalesce(stop, 1000)""",
    "h_layer_histories": f"""WITH {LAYER_SAT} SELECT st.index, st.layer, iteration - 1 AS step, delta
      FROM st JOIN sat ON sat.index = st.index AND sat.layer = st.layer
      WHERE iteration <= coalesce(completed, last)""",
    "loss_deltas": f"WITH {HIST} SELECT index, iteration, round(loss, 6) AS loss, round(delta, 6) "
                   "AS delta FROM cut",
    "stable_runs": f"""WITH {HIST}, rd AS (SELECT * REPLACE (round(delta, 6) AS delta) FROM cut),
        {islands('index', 40, 'rd')} SELECT index, iteration, stable_run FROM st""",
    "h_long_series": f"""WITH {ONE}, rd AS (SELECT * REPLACE (round(delta, 6) AS delta) FROM cut),
        {islands('index', 98, 'rd')} SELECT iteration, stable_run FROM st""",
    "h_history_chunks": f"""WITH {ONE}, {islands('index', 98)}, z AS (SELECT index, loss, iteration,
        min(iteration) FILTER (stable_run >= 50) OVER () AS stop FROM st)
      SELECT index, iteration // 16 AS chunk, (iteration // 16) * 16 AS first_iteration,
        CAST(iteration % 16 AS INTEGER) AS step, round(loss, 6) AS loss FROM z
      WHERE stop IS NULL OR iteration <= stop""",
    # schedules
    "signals_asof": f"""WITH {runs(8)}, {LINEAR_03}, steps AS (SELECT run, epoch, n_active,
        TIMESTAMP '2024-01-01 06:00:00' + INTERVAL 1 DAY * (epoch - 1) AS at FROM lin)
      SELECT e.event_id, e.event_type AS run,
        CASE WHEN e.ts < s.at + INTERVAL 20 HOUR THEN s.epoch END AS epoch,
        CASE WHEN e.ts < s.at + INTERVAL 20 HOUR THEN s.n_active END AS n_active
      FROM events e ASOF LEFT JOIN steps s ON e.event_type = s.run AND e.ts >= s.at""",
    "schedule_linear": f"WITH {runs(8)}, {LINEAR_03} SELECT * FROM lin",
    "schedule_linear_order": f"""WITH {runs(200)}, {LINEAR.format(full=20, f0='0.2', rest='0.8')}
      SELECT run, epoch, CAST(s AS INTEGER) AS slot, CAST(s AS INTEGER) AS batch_idx
      FROM lin, range(100000) r(s) WHERE s < n_active""",
    "schedule_adaptive": ADAPTIVE,
    "stream_pacing": ADAPTIVE,
    "stream_order_gradient": streamed_order("mean_grad_norm", 2, 1),
    "stream_order_uncertainty": streamed_order("mean_entropy", 1, 2),
    "schedule_gradient": signal_order("mean_grad_norm", 2, 1),
    "schedule_uncertainty": signal_order("mean_entropy", 1, 2),
    "signal_loss_plateau": f"WITH {EPO}, {LOSS_SIGNAL} SELECT run, epoch, round(signal, 8) AS signal "
                           "FROM ls",
    "signal_val_trend": f"WITH {EPO}, {VAL_SIGNAL} SELECT run, epoch, round(signal, 8) AS signal "
                        "FROM vs",
    "signal_activation": f"WITH {SIG}, {plateau('ps', 'mean_std')}, {carried('act', 'ps')} SELECT "
                         "run, epoch, round(signal, 8) AS signal FROM act",
    "signal_gradient": f"WITH {SIG}, {plateau('pg', 'mean_grad_norm', 4)}, {carried('grd', 'pg')} "
                       "SELECT run, epoch, round(signal, 8) AS signal FROM grd",
    "plateau_detect": f"WITH {SIG}, {plateau('ps', 'mean_std')} SELECT run, batch_idx, epoch, "
                      "is_plateau, round(stability, 8) AS stability FROM ps",
    "readiness": f"WITH {READY} SELECT run, epoch, " + ", ".join(
        f"round({c}, 8) AS {c}" for c in ("r_loss", "r_val", "r_act", "r_grad", "readiness"))
        + " FROM ready",
    "running_means": f"WITH {means('mean_grad_norm')} SELECT run, epoch, batch_idx, round(mean, 8) "
                     "AS mean FROM means",
    "smooth_centered": f"WITH {means('mean_entropy')}, {smoothed(2)} SELECT run, epoch, batch_idx, "
                       "round(smooth, 8) AS smooth FROM sm",
    "exposure": f"""WITH {runs(200)}, {LINEAR_03}, x AS (SELECT run, 1 AS epoch, total_batches AS n
        FROM runs UNION ALL SELECT run, epoch + 1, n_active FROM lin WHERE epoch < 30)
      SELECT run, epoch, CAST(s AS INTEGER) AS slot, CAST(s AS INTEGER) AS batch_idx
      FROM x, range(100000) r(s) WHERE s < n""",
    "exposure_dsi": f"""WITH {runs(8)}, {LINEAR_03}, x AS (SELECT run, 1 AS epoch, total_batches AS
        n_active FROM runs UNION ALL SELECT run, epoch + 1, n_active FROM lin WHERE epoch < 30)
      SELECT run, epoch, n_active, round(n_active / CAST(total_batches AS DOUBLE), 6) AS share,
        CAST(sum(n_active) OVER (PARTITION BY run ORDER BY epoch) AS BIGINT) AS cumulative_batches,
        round(1 - sum(n_active) OVER (PARTITION BY run) / (total_batches * 30.0::DOUBLE), 4) AS dsi
      FROM x JOIN runs USING (run)""",
    # telemetry and runs
    "epoch_metrics": f"""WITH {LOGITS}, b AS (SELECT batch_idx, avg(cross_entropy) AS loss,
        sum(CAST(predicted = label AS INTEGER)) AS hits, count(*) AS n FROM smp GROUP BY batch_idx)
      SELECT 'run' AS run, 1 AS epoch, round(sum(hits) / CAST(sum(n) AS DOUBLE), 4) AS accuracy,
        round(avg(loss), 4) AS loss, CAST(count(*) AS INTEGER) AS batches FROM b""",
    "batch_entropy": f"WITH {LOGITS} SELECT 'run' AS run, 1 AS epoch, CAST(batch_idx AS INTEGER) AS "
                     "batch_idx, round(avg(entropy), 8) AS mean_entropy FROM smp GROUP BY batch_idx",
    "sample_cross_entropy": f"WITH {LOGITS} SELECT index, round(cross_entropy, 8) AS cross_entropy, "
                            "predicted, predicted = label AS correct FROM smp",
    "batch_activation_std": f"WITH {LAYER_VALUES} SELECT run, epoch, batch_idx, round(avg(s), 6) AS "
                            "mean_std FROM per GROUP BY ALL",
    "batch_grad_norm": f"WITH {LAYER_VALUES} SELECT run, epoch, batch_idx, round(avg(n), 6) AS "
                       "mean_grad_norm FROM per GROUP BY ALL",
    "batch_signals": f"WITH {LAYER_VALUES} SELECT run, epoch, batch_idx, round(avg(s), 6) AS "
                     "mean_std, round(avg(n), 6) AS mean_grad_norm FROM per GROUP BY ALL",
    "batch_signals_three": """WITH lv AS (SELECT l_returnflag AS run, CAST(month(l_shipdate) AS INTEGER)
        AS epoch, CAST(l_suppkey % 10 AS INTEGER) AS batch_idx, * FROM lineitem),
      per AS (SELECT run, epoch, batch_idx, l_linenumber, stddev_samp(l_quantity) AS s,
        sqrt(sum(l_discount * l_discount)) AS n, sum(l_tax) FILTER (l_linenumber < 4) AS e,
        count(*) FILTER (l_linenumber < 4) AS k FROM lv GROUP BY ALL)
      SELECT run, epoch, batch_idx, round(avg(s), 6) AS mean_std, round(avg(n), 6) AS mean_grad_norm,
        round(sum(e) / nullif(sum(k), 0), 6) AS mean_entropy FROM per GROUP BY ALL""",
    "run_best_epoch": f"WITH {EPO}, {BEST} SELECT run, best_epoch, best_accuracy AS "
                      "best_accuracy, best_loss AS best_loss FROM best",
    "run_final": f"WITH {EPO}, {FINAL} SELECT run, " + ", ".join(
        f"{c}" for c in ("final_train_accuracy", "final_train_loss",
                                          "final_val_accuracy", "final_val_loss")) + " FROM fin",
    "run_dsi": f"WITH {EPO}, {USED} SELECT run, dsi FROM used",
    "run_series": f"""WITH {EPO} SELECT run, CAST(sum(batches) OVER (PARTITION BY run) AS BIGINT) AS
        total_batches_processed, CAST(row_number() OVER (PARTITION BY run ORDER BY epoch) - 1 AS
        INTEGER) AS step, batches AS batches_per_epoch, train_acc AS train_accuracies,
        train_loss AS train_losses, val_acc AS validation_accuracies,
        val_loss AS validation_losses FROM epo""",
    "run_summary": f"""WITH {EPO}, {BEST}, {FINAL}, {USED} SELECT run, best_epoch,
        best_accuracy AS best_accuracy, best_loss AS best_loss,
        final_train_accuracy AS final_train_accuracy,
        final_train_loss AS final_train_loss,
        final_val_accuracy AS final_val_accuracy,
        final_val_loss AS final_val_loss, dsi, 10 AS max_batches_per_epoch,
        total_batches_processed FROM best JOIN fin USING (run) JOIN used USING (run)""",
    "run_hash": f"WITH {CONFIG} SELECT run, hash FROM hsh",
    "run_row": f"""WITH {RECORDS} SELECT network AS network_id, 'events' AS dataset_id, 30 AS epochs,
        1 AS seed, 'cpu' AS device, final_val_accuracy AS final_accuracy,
        final_val_loss AS final_loss, best_accuracy AS best_accuracy,
        best_loss AS best_loss, best_epoch, shuffled, false AS normalize_classes,
        CASE WHEN paced THEN 'ascending' END AS rank, CASE WHEN paced THEN 'metric-' || run END AS
        metric, CASE WHEN paced THEN 'holistic' END AS scope, CASE WHEN paced THEN 'linear' END AS
        schedule, 0.3::DOUBLE AS start_fraction, dsi, 10 AS max_batches_per_epoch,
        total_batches_processed, 'records/' || network || '_events/' || hash || '.json' AS
        record_file, hash
      FROM best JOIN fin USING (run) JOIN used USING (run) JOIN hsh USING (run)""",
    "run_exists": f"WITH {CONFIG} SELECT run FROM hsh WHERE NOT paced",
    "run_append": f"WITH {RECORDS} SELECT hash, network AS network_id, best_accuracy AS "
                  "best_accuracy, best_epoch FROM best JOIN hsh USING (run)",
    "run_documents": f"""WITH {RECORDS} SELECT hash, network, best_epoch, total_batches_processed,
        val_acc AS acc_7 FROM best JOIN used USING (run) JOIN hsh USING (run)
        JOIN epo ON epo.run = hsh.run AND epo.epoch = 7""",
    "epoch_upsert": """SELECT event_type AS run, CAST(day(ts) AS INTEGER) AS epoch, value, user_id
      FROM events QUALIFY row_number() OVER (PARTITION BY event_type, day(ts) ORDER BY event_id DESC)
      = 1""",
    "runs_compare": f"""WITH {RECORDS}, a AS (SELECT CASE WHEN paced THEN 'curriculum' WHEN shuffled
        THEN 'shuffled' ELSE 'baseline' END AS kind, best_accuracy AS v FROM best JOIN hsh
        USING (run)), w AS (SELECT max(v) FILTER (kind = 'baseline') AS b,
        max(v) FILTER (kind = 'shuffled') AS s, max(v) FILTER (kind = 'curriculum') AS c FROM a)
      SELECT 'net' AS network_id, 'events' AS dataset_id, b AS baseline,
        s AS shuffled, c AS curriculum, s - b AS shuffled_gain,
        c - b AS curriculum_gain FROM w""",
    "experiment_grid": """SELECT dataset, model, rank FROM (SELECT DISTINCT event_type AS dataset FROM
        events), (VALUES ('resnet-18'), ('resnet-34'), ('resnet-50'), ('resnet-101')) m(model),
        (VALUES ('ascending'), ('descending')) r(rank)
      WHERE NOT (model = 'resnet-18' AND rank = 'ascending')""",
    "rank_pairwise_small": f"""WITH RECURSIVE {SO}, base AS (SELECT *, CAST((row_number() OVER (ORDER BY
        md5('1:' || index), index) - 1) // 12 AS INTEGER) AS batch_idx FROM so),
      {unit_vectors('PARTITION BY batch_idx')}, drawn AS (SELECT *, row_number() OVER (PARTITION BY
        batch_idx ORDER BY md5('1:' || index), index) AS rn FROM u), {votes()}
      SELECT batch_idx, CAST(row_number() OVER (PARTITION BY batch_idx ORDER BY weight, index) - 1
        AS INTEGER) AS pos_in_batch, index FROM done""",
    "rank_pairwise_suppliers": f"""WITH RECURSIVE {SUPPLIERS}, {unit_vectors()},
      drawn AS (SELECT *, row_number() OVER (ORDER BY index) AS rn FROM u), {votes()}
      SELECT index, row_number() OVER (ORDER BY round(weight, 9), index) - 1 AS position FROM done""",
    "pair_correlation_sums": f"""WITH {SO}, base AS (SELECT *, CAST((row_number() OVER (ORDER BY
        md5('1:' || index), index) - 1) // 128 AS INTEGER) AS batch_idx FROM so),
      {unit_vectors('PARTITION BY batch_idx')}
      SELECT a.batch_idx, a.index, round(coalesce(sum({" + ".join(
          f"a.x{i} * b.x{i}" for i in range(5))}), 0), 5) + 0.0::DOUBLE AS vote
      FROM u a LEFT JOIN u b ON a.batch_idx = b.batch_idx AND a.index <> b.index
      GROUP BY a.batch_idx, a.index""",
    # streams
    "stream_distributions": f"WITH {SO}, long AS (" + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, class, {m} AS v FROM so" for m in METRICS) + """)
      SELECT metric, s AS scope, count(v) AS count, round(avg(v), 5) AS mean, round(max(v), 5) AS
        maximum, round(min(v), 5) AS minimum, round(stddev_samp(v), 5) AS std FROM (
        SELECT metric, 'global' AS s, v FROM long UNION ALL SELECT metric, class, v FROM long)
      GROUP BY metric, s""",
}
_BOTH = f"""WITH {RGB}, {RGB_VAR}, {RGB_GRAY}, {frequency('gray')},
  cv AS (SELECT index, avg(value) AS value FROM vars GROUP BY index)
  SELECT index, CAST(label AS VARCHAR) AS class, round(cv.value, 8) AS color_variance,
    round(sqrt(row_frequency * row_frequency + column_frequency * column_frequency), 8) AS
    spatial_frequency
  FROM cv JOIN freq USING (index) JOIN (SELECT vec_id AS index, label FROM embeddings)
  USING (index)"""
ORACLE["score_all_native"] = ORACLE["score_all_kernels"] = ORACLE["stream_scoring"] = _BOTH

ORACLE["rank_cached_weighted"] = ORACLE["rank_weighted"]
ORACLE["rank_cached_inverted"] = ORACLE["rank_normalized_mean"]
ORACLE["metric_distributions_brackets"] = ORACLE["metric_distributions"]
ORACLE["stream_quantiles"] = (
    "SELECT metric, scope, count, true AS p25_within, true AS p50_within, true AS p75_within "
    f"FROM ({ORACLE['metric_distributions']}) WHERE count > 0")
ORACLE["distributions_csv"] = ORACLE["metric_distributions"]
ORACLE["scores_csv"] = f"WITH {SO} SELECT index, class, " + ", ".join(
    f"CAST({m} AS DOUBLE) AS {m}" for m in METRICS) + " FROM so"
ORACLE["score_histories"] = f"""WITH {PX}, vr AS (SELECT index, any_value(label) AS label,
    var_samp(CAST(v AS DOUBLE)) AS cv FROM px GROUP BY index)
  SELECT index, CAST(label AS VARCHAR) AS class, round(cv, 8) AS color_variance,
    c.value AS convergence_time, s.value AS saturation_time FROM vr
  LEFT JOIN ({ORACLE["h_convergence_time"]}) c USING (index)
  LEFT JOIN ({ORACLE["h_saturation_time"]}) s USING (index)"""
ORACLE["rank_pairwise_chunked"] = ORACLE["rank_pairwise_small"].replace("// 12 AS INTEGER", "// 128 AS INTEGER")
