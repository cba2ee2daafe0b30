"""Exports, summaries and readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from netweave.functions import labels
from netweave.operators import hydraulics
from netweave.plans.fixtures import BASE, PIPES, net_nodes, net_pipes
from netweave.plans.registry import query
from netweave.session import shared_path, table
from netweave.sources import drawing, export
from netweave.streaming import readings, sampling


@query("geojson_features", f"""WITH {BASE} SELECT '{{"type":"Feature","properties":{{"node_id":' || node_id || ',"degree":' || degree || ',"node_type":"' || node_type || '","deep":' || CAST(degree > 2 AS INTEGER) || '}},"geometry":{{"type":"Point","coordinates":[' || CAST(node_id AS DOUBLE) / 8 || ',' || CAST(degree AS DOUBLE) / 4 || ']}}}}' AS feature FROM nodes""")
def geojson_features(spark, sf_dir):
    nodes = net_nodes(spark, sf_dir).withColumn("deep", F.col("degree") > 2)
    return export.geojson_points(nodes, ["node_id", "degree", "absent", "node_type", "deep"], F.col("node_id") / 8, F.col("degree") / 4)


@query("inp_lines", f"""WITH {BASE}, {PIPES}, src AS (SELECT node_id FROM (SELECT node1 AS node_id, y1 AS y FROM pipes WHERE diameter_mm = (SELECT max(diameter_mm) FROM pipes) UNION ALL SELECT node2, y2 FROM pipes WHERE diameter_mm = (SELECT max(diameter_mm) FROM pipes)) ORDER BY y DESC, node_id LIMIT 1)
  SELECT 'JUNCTIONS' AS section, concat_ws(chr(9), 'J' || node_id, CAST(CAST(elevation_m AS DECIMAL(28,4)) AS VARCHAR), CAST(CAST(demand_lps AS DECIMAL(28,6)) AS VARCHAR), 'PEAK') AS line FROM nodes
  UNION ALL SELECT 'PIPES', concat_ws(chr(9), 'P' || link_id, 'J' || node1, 'J' || node2, CAST(CAST(floor(length_m) AS DECIMAL(28,3)) AS VARCHAR), CAST(CAST(diameter_mm AS DECIMAL(28,2)) AS VARCHAR), '110.0', '0', 'OPEN') FROM pipes
  UNION ALL SELECT 'PIPES', 'P_SRC' || chr(9) || 'R1' || chr(9) || 'J' || node_id || chr(9) || '25' || chr(9) || '300' || chr(9) || '130' || chr(9) || '0' || chr(9) || 'OPEN' FROM src
  UNION ALL SELECT 'COORDINATES', concat_ws(chr(9), 'J' || node_id, CAST(CAST(x AS DECIMAL(28,3)) AS VARCHAR), CAST(CAST(y AS DECIMAL(28,3)) AS VARCHAR)) FROM nodes
  UNION ALL SELECT * FROM (VALUES ('JUNCTIONS', '[JUNCTIONS]'), ('RESERVOIRS', '[RESERVOIRS]'), ('RESERVOIRS', 'R1' || chr(9) || '111.7000'), ('PIPES', '[PIPES]'), ('PATTERNS', '[PATTERNS]'), ('PATTERNS', 'PEAK' || chr(9) || '2.5'), ('TIMES', '[TIMES]'), ('TIMES', 'DURATION' || chr(9) || '0'), ('OPTIONS', '[OPTIONS]'), ('OPTIONS', 'UNITS' || chr(9) || 'LPS'), ('OPTIONS', 'HEADLOSS' || chr(9) || 'H-W'), ('OPTIONS', 'ACCURACY' || chr(9) || '0.001'), ('COORDINATES', '[COORDINATES]'), ('END', '[END]'))""")
def inp_lines(spark, sf_dir):
    pipes = net_pipes(spark, sf_dir)
    sized = pipes.withColumn("length_m", F.floor("length_m").cast("double")).withColumn("roughness", labels.roughness(F.lit("UNK")))
    return export.inp_lines(net_nodes(spark, sf_dir), sized, hydraulics.pick_source(pipes), 2.5, 111.7).select("section", "line")


def _corners():
    return F.array(F.array(*[F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in (1, 2)]))


@query("drawing_lines", f"WITH {BASE}, {PIPES} SELECT 'zone ' || cluster AS layer, x1, y1, x2, y2 FROM pipes")
def drawing_lines(spark, sf_dir):
    """All pipes as drawings, read back."""
    path = shared_path(spark, "drawing")
    lines = net_pipes(spark, sf_dir).select(F.concat(F.lit("zone "), "cluster").alias("layer"), _corners().alias("parts"), F.lit(None).cast("string").alias("Text"))
    drawing.drawing_text(lines).write.text(path)
    found = drawing.read_drawing(spark, path).withColumn("p", F.get("parts", F.lit(0)))
    return found.select("layer", *[F.get("p", F.lit(i))[c].alias(f"{c}{i + 1}") for i in (0, 1) for c in "xy"])


@query("wkt_lines", f"WITH {BASE}, {PIPES} SELECT link_id, 'LINESTRING (' || regexp_replace(CAST(x1 AS VARCHAR), '\\.0$', '') || ' ' || regexp_replace(CAST(y1 AS VARCHAR), '\\.0$', '') || ', ' || regexp_replace(CAST(x2 AS VARCHAR), '\\.0$', '') || ' ' || regexp_replace(CAST(y2 AS VARCHAR), '\\.0$', '') || ')' AS wkt, x1 AS first_x, 2 AS n_points FROM pipes")
def wkt_lines(spark, sf_dir):
    """All pipes as well-known text, and what is read from it."""
    shapes = net_pipes(spark, sf_dir).select("link_id", drawing.to_wkt(F.lit("LineString"), _corners()).alias("wkt"))
    points = F.get(drawing.from_wkt(F.col("wkt"))[1], F.lit(0))
    return shapes.select("link_id", "wkt", F.get(points, F.lit(0))["x"].alias("first_x"), F.size(points).alias("n_points"))


@query("observation_medians", "SELECT event_type AS property, 'U' || user_id AS station, date_trunc('minute', ts) AS start, quantile_cont(floor(value), 0.5) AS median, count(*) AS n FROM events GROUP BY ALL")
def observation_medians(spark, sf_dir):
    return readings.medians(_readings(spark, sf_dir)).select("property", "station", "start", "median", "n")


def _readings(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.concat(F.lit("U"), "user_id").alias("station"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("property"), F.floor("value").cast("double").alias("value"))


@query("observation_breaches", "WITH m AS (SELECT event_type AS property, 'U' || user_id AS station, date_trunc('minute', ts) AS start, quantile_cont(floor(value), 0.5) AS median, count(*) AS n FROM events GROUP BY ALL), r(property, low, high) AS (VALUES ('click', 10.0, 60.0), ('view', NULL, 50.0), ('purchase', 20.0, NULL)) SELECT station, m.property, start, median, n, CASE WHEN median < low THEN 'low' ELSE 'high' END AS side FROM m JOIN r USING (property) WHERE median < low OR median > high")
def observation_breaches(spark, sf_dir):
    ranges = readings.permissible(spark, {"click": (10.0, 60.0), "view": (None, 50.0), "purchase": (20.0, None)})
    return readings.breaches(observation_medians(spark, sf_dir), ranges)


#: Samples from clicks, their bursts of 21 (a pause of a day ends one) and ranges.
_SAMPLES = """WITH s AS (SELECT 'C' || client_id AS station, kind AS property, ts, click_id AS sample, min(floor(value * 8)) AS value FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL AND click_id IS NOT NULL AND isfinite(value) GROUP BY ALL),
  g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 86400000000, TRUE) AS new FROM s WINDOW w AS (PARTITION BY station, property ORDER BY ts, sample)),
  r AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY station, property ORDER BY ts, sample) AS run FROM g),
  a AS (SELECT *, (row_number() OVER (PARTITION BY station, property, run ORDER BY ts, sample) - 1) // 21 AS burst FROM r),
  b AS (SELECT station, property, min(ts) AS start, arg_min(sample, struct_pack(t := ts, s := sample)) AS sample, max(ts) AS "end", quantile_cont(value, 0.5) AS value, count(*) AS n FROM a GROUP BY station, property, run, burst)"""
_IDLE = 86400.0


def _samples(spark, sf_dir):
    return table(spark, sf_dir, "clicks").select(F.concat(F.lit("C"), "client_id").alias("station"), F.col("kind").alias("property"), F.col("ts").cast("timestamp").alias("ts"), F.col("click_id").alias("sample"), F.floor(F.col("value") * 8).cast("double").alias("value"))


@query("sample_bursts", f'{_SAMPLES} SELECT station, property, start, sample, "end", value, n FROM b')
def sample_bursts(spark, sf_dir):
    """Medians of 21 samples, as a station publishes them."""
    return sampling.bursts(_samples(spark, sf_dir), _IDLE)


@query("breach_episodes", f"""{_SAMPLES}, k(property, low, high) AS (VALUES ('click', 300.0, 420.0), ('view', NULL, 400.0), ('purchase', 300.0, NULL)),
  j AS (SELECT b.*, CASE WHEN value < low THEN 'low' WHEN value > high THEN 'high' END AS side FROM b LEFT JOIN k USING (property)),
  l AS (SELECT *, coalesce(side IS DISTINCT FROM lag(side) OVER w OR epoch_us(start) - epoch_us(lag("end") OVER w) > 86400000000, TRUE) AS new FROM j WINDOW w AS (PARTITION BY station, property ORDER BY start, sample)),
  m AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY station, property ORDER BY start, sample) AS run FROM l)
  SELECT station, property, min(start) AS start, max("end") AS "end", CASE side WHEN 'low' THEN min(value) ELSE max(value) END AS value, count(*) AS n, side FROM m WHERE side IS NOT NULL GROUP BY station, property, run, side""")
def breach_episodes(spark, sf_dir):
    """Runs of published readings that are out of range on one side."""
    ranges = readings.permissible(spark, {"click": (300.0, 420.0), "view": (None, 400.0), "purchase": (300.0, None)})
    return sampling.episodes(sample_bursts(spark, sf_dir), ranges, _IDLE)


@query("network_report", f"WITH {BASE}, {PIPES} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM pipes) AS n_pipes, (SELECT CAST(sum(CAST(demand_lps AS DECIMAL(28,6))) AS DOUBLE) FROM nodes) AS demand_lps, (SELECT max(pressure_m) FROM nodes) AS pressure_max")
def network_report(spark, sf_dir):
    nodes, pipes = net_nodes(spark, sf_dir), net_pipes(spark, sf_dir)
    figures = nodes.agg(F.count("*").alias("n_nodes"), F.sum(F.col("demand_lps").cast("decimal(28,6)")).cast("double").alias("demand_lps"), F.max("pressure_m").alias("pressure_max"))
    return figures.crossJoin(pipes.agg(F.count("*").alias("n_pipes"))).select("n_nodes", "n_pipes", "demand_lps", "pressure_max")  # one row each
