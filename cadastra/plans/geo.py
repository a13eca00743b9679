"""Queries over geo features and locations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.operators import geo as G
from cadastra.operators import shapes
from cadastra.plans.base import query


@query("spatial_match", """SELECT a.feature_id AS location_id, b.feature_id, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) * 1e6, 6) AS overlap
    FROM (SELECT feature_id, x0 - 0.0005 AS x0, y0 - 0.0005 AS y0, x1 + 0.0004 AS x1, y1 + 0.0004 AS y1 FROM {d_parcels} WHERE feature_id % 10 = 0) a
    JOIN d_parcels b ON least(a.x1, b.x1) - greatest(a.x0, b.x0) > 1e-12 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 1e-12""")
def spatial_match(t):
    p = t.d_parcels
    locations = p.where("feature_id % 10 = 0").select(F.col("feature_id").alias("location_id"), (F.col("x0") - 0.0005).alias("x0"), (F.col("y0") - 0.0005).alias("y0"), (F.col("x1") + 0.0004).alias("x1"), (F.col("y1") + 0.0004).alias("y1"))
    out = G.spatial_match(locations, p.select("feature_id", "x0", "y0", "x1", "y1"))
    return out.select("location_id", "feature_id", F.round(F.col("overlap") * 1e6, 6).alias("overlap"))


_INSIDE = "SELECT address_id, feature_id FROM {d_addresses} a JOIN {d_parcels} p ON a.x >= p.x0 AND a.x < p.x1 AND a.y >= p.y0 AND a.y < p.y1"


@query("contains_parcel", f"WITH i AS ({_INSIDE}) SELECT a.address_id, min(i.feature_id) AS feature_id FROM d_addresses a LEFT JOIN i USING (address_id) GROUP BY a.address_id")
def contains_parcel(t):
    return G.containing_parcel(t.d_addresses, t.d_parcels)


@query("multi_unit", f"WITH i AS ({_INSIDE}) SELECT p.feature_id, count(address_id) >= 2 AS multi_unit FROM d_parcels p LEFT JOIN i USING (feature_id) GROUP BY p.feature_id")
def multi_unit(t):
    return G.multi_unit(t.d_parcels, t.d_addresses)


_LINES = """SELECT s_suppkey AS line_id, CASE WHEN s_suppkey % 2 = 0 THEN -63.6 ELSE -63.6 + (s_suppkey % 40) * 0.001 END AS x0, CASE WHEN s_suppkey % 2 = 0 THEN 44.6 + (s_suppkey % 40) * 0.001 ELSE 44.6 END AS y0,
    CASE WHEN s_suppkey % 2 = 0 THEN -63.59 ELSE -63.6 + (s_suppkey % 40) * 0.001 END AS x1, CASE WHEN s_suppkey % 2 = 0 THEN 44.6 + (s_suppkey % 40) * 0.001 ELSE 44.61 END AS y1 FROM {supplier}"""


@query("nearby_lines", f"WITH l AS ({_LINES}) SELECT feature_id, line_id FROM {{d_parcels}} p JOIN l ON p.x0 - 0.0015 <= l.x1 AND p.x1 + 0.0015 >= l.x0 AND p.y0 - 0.0015 <= l.y1 AND p.y1 + 0.0015 >= l.y0")
def nearby_lines(t):
    lines = t.spark.sql(_LINES, supplier=t.supplier)
    return G.nearby_lines(t.d_parcels, lines, pad=0.0015)


@query(
    "lot_metrics",
    "SELECT feature_id, round(w, 4) AS width_m, round(h, 4) AS height_m, round(w * h, 2) AS area_m2, round(2 * (w + h), 4) AS perimeter_m FROM (SELECT feature_id, (x1 - x0) * 111320.0 * cos(radians((y0 + y1) / 2)) AS w, (y1 - y0) * 111320.0 AS h FROM {d_parcels})",
)
def lot_metrics(t):
    m = G.lot_metrics(t.d_parcels)
    return m.select("feature_id", *[F.round(c, 2 if c == "area_m2" else 4).alias(c) for c in ("width_m", "height_m", "area_m2", "perimeter_m")])


def _point(x, y):
    return F.struct(F.col(x) if isinstance(x, str) else x, F.col(y) if isinstance(y, str) else y).cast("struct<x:double,y:double>")


#: An L of three quarters of a lot's box with a square hole, as rectangles (the hole counts against it); a lot of three has an island in the hole.
_ELL = """SELECT feature_id, x0 + u[1] * 0.001 AS x0, y0 + u[2] * 0.001 AS y0, x0 + u[3] * 0.001 AS x1, y0 + u[4] * 0.001 AS y1, u[5] AS sign FROM (
        SELECT feature_id, x0, y0, unnest([[0, 0, 1, 0.5, 1], [0, 0.5, 0.5, 1, 1], [0.1, 0.1, 0.4, 0.4, -1]] || CASE WHEN feature_id % 3 = 0 THEN [[0.2, 0.2, 0.3, 0.3, 1]] ELSE [] END) AS u FROM {d_parcels})"""


@query(
    "polygon_match",
    f"""WITH e AS ({_ELL}), l AS (SELECT feature_id AS location_id, x0 - 0.0004 AS x0, y0 - 0.0013 AS y0, x1 + 0.0007 AS x1, y1 + 0.0002 AS y1 FROM d_parcels WHERE feature_id % 5 = 0),
        o AS (SELECT location_id, feature_id, sum(sign * greatest(least(l.x1, e.x1) - greatest(l.x0, e.x0), 0) * greatest(least(l.y1, e.y1) - greatest(l.y0, e.y0), 0)) AS overlap
              FROM l JOIN e ON l.x0 < e.x1 AND l.x1 > e.x0 AND l.y0 < e.y1 AND l.y1 > e.y0 GROUP BY location_id, feature_id)
        SELECT location_id, feature_id, round(overlap * 1e6, 6) AS overlap, false AS contains_input FROM o WHERE overlap > 1e-12""",
)
def polygon_match(t):
    """Boxes around every fifth lot against all L-shaped lots with holes and islands."""
    p = t.d_parcels
    at = lambda u, v: _point(F.col("x0") + u * 0.001, F.col("y0") + v * 0.001)
    square = lambda a, b: F.array(at(a, a), at(b, a), at(b, b), at(a, b))
    ell = F.array(at(0, 0), at(1, 0), at(1, 0.5), at(0.5, 0.5), at(0.5, 1), at(0, 1))
    rings = F.when(F.col("feature_id") % 3 == 0, F.array(ell, square(0.1, 0.4), square(0.2, 0.3))).otherwise(F.array(ell, square(0.1, 0.4)))
    x0, y0, x1, y1 = F.col("x0") - 0.0004, F.col("y0") - 0.0013, F.col("x1") + 0.0007, F.col("y1") + 0.0002
    box = F.array(F.array(_point(x0, y0), _point(x1, y0), _point(x1, y1), _point(x0, y1)))
    locations = p.where("feature_id % 5 = 0").select(F.col("feature_id").alias("location_id"), F.lit("polygon").alias("kind"), box.alias("parts"))
    out = shapes.shape_match(locations, p.select("feature_id", rings.alias("parts")))
    return out.where("overlap > 1e-12").select("location_id", "feature_id", F.round(F.col("overlap") * 1e6, 6).alias("overlap"), "contains_input")


@query(
    "lot_frontage",
    """WITH p AS (SELECT feature_id, (x0 + x1) / 2 AS lon0, (y0 + y1) / 2 AS lat0, x0, y0, x1, y1, 111320.0 * cos(radians((y0 + y1) / 2)) AS k FROM {d_parcels}),
        e AS (SELECT feature_id, edge, edge % 2 AS upright, k, lon0, lat0, CASE WHEN edge % 2 = 0 THEN (x0 - lon0) * k ELSE (y0 - lat0) * 111320.0 END AS a, CASE WHEN edge % 2 = 0 THEN (x1 - lon0) * k ELSE (y1 - lat0) * 111320.0 END AS b,
                    CASE edge WHEN 0 THEN (y0 - lat0) * 111320.0 WHEN 2 THEN (y1 - lat0) * 111320.0 WHEN 1 THEN (x1 - lon0) * k ELSE (x0 - lon0) * k END AS c FROM p, (SELECT unnest([0, 1, 2, 3]) AS edge)),
        m AS (SELECT e.feature_id, edge, a, b, c, upright, (CASE WHEN upright = 0 THEN (s.x0 - lon0) * k ELSE (s.y0 - lat0) * 111320.0 END) AS s0, (CASE WHEN upright = 0 THEN (s.x1 - lon0) * k ELSE (s.y1 - lat0) * 111320.0 END) AS s1,
                    (CASE WHEN upright = 0 THEN (s.y0 - lat0) * 111320.0 ELSE (s.x0 - lon0) * k END) AS o0, (CASE WHEN upright = 0 THEN (s.y1 - lat0) * 111320.0 ELSE (s.x1 - lon0) * k END) AS o1
              FROM e JOIN {d_streets} s ON abs(e.lat0 - (s.y0 + s.y1) / 2) < 0.01 AND abs(e.lon0 - (s.x0 + s.x1) / 2) < 0.01),
        d AS (SELECT *, greatest(o0 - c, c - o1, 0) AS off FROM m),
        i AS (SELECT feature_id, edge, a, b, greatest(a, s0 - sqrt(64 - off * off)) AS t0, least(b, s1 + sqrt(64 - off * off)) AS t1 FROM d WHERE off <= 8 AND s0 - sqrt(greatest(64 - off * off, 0)) < b AND s1 + sqrt(greatest(64 - off * off, 0)) > a),
        f AS (SELECT *, CASE WHEN t0 > max(t1) OVER (PARTITION BY feature_id, edge ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM i WHERE t0 < t1),
        n AS (SELECT *, sum(fresh) OVER (PARTITION BY feature_id, edge ORDER BY t0, t1) AS piece FROM f),
        g AS (SELECT feature_id, edge, piece, max(t1) - min(t0) AS len FROM n GROUP BY ALL),
        h AS (SELECT feature_id, sum(len) AS frontage, count(DISTINCT edge % 2) FILTER (WHERE len >= 8.8) AS ways FROM g GROUP BY feature_id)
        SELECT p.feature_id, round((x1 - x0) * k * (y1 - y0) * 111320.0, 2) AS area_m2, round(2 * ((x1 - x0) * k + (y1 - y0) * 111320.0), 4) AS perimeter_m, round(coalesce(frontage, 0), 4) AS frontage_m,
               round(CASE WHEN frontage > 1 THEN (x1 - x0) * k * (y1 - y0) * 111320.0 / frontage END, 3) AS depth_m, coalesce(ways = 2, false) AS corner FROM p LEFT JOIN h USING (feature_id)""",
)
def lot_frontage(t):
    """Frontage, depth and corners of all lots along streets that run east or north; curved ones are in the tests."""
    ring = F.array(_point("x0", "y0"), _point("x1", "y0"), _point("x1", "y1"), _point("x0", "y1"))
    streets = t.d_streets.select("line_id", F.array(_point("x0", "y0"), _point("x1", "y1")).alias("points"))
    out = shapes.lot_frontage(t.d_parcels.select("feature_id", ring.alias("ring")), streets)
    places = {"area_m2": 2, "perimeter_m": 4, "frontage_m": 4, "depth_m": 3}
    return out.select("feature_id", *[F.round(c, n).alias(c) for c, n in places.items()], "corner")


@query("feature_bbox", "SELECT feature_id, x0, y0, x1, y1 FROM {d_parcels}")
def feature_bbox(t):
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))
    return t.d_parcels.select("feature_id", G.ring_bbox(ring).alias("b")).select("feature_id", "b.*")


@query("ring_area", "SELECT feature_id, round((x1 - x0) * (y1 - y0) * 1e6 / 2, 6) AS area FROM {d_parcels}")
def ring_area(t):
    corner = lambda x, y: F.struct((F.col(x) + 63.6).alias("x"), (F.col(y) - 44.6).alias("y"))
    return t.d_parcels.select("feature_id", F.round(G.ring_area(F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"))) * 1e6, 6).alias("area"))


@query("ring_contains", "SELECT feature_id, c_custkey % 2 = 0 AS inside FROM {d_parcels} JOIN {customer} ON c_custkey = feature_id")
def ring_contains(t):
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"))
    even = F.col("feature_id") % 2 == 0
    # The lower right half of the square is the triangle; odd lots test a point of the other half.
    x = F.col("x0") + F.when(even, 0.0008).otherwise(0.0002)
    y = F.col("y0") + F.when(even, 0.0002).otherwise(0.0008)
    return t.d_parcels.select("feature_id", G.ring_contains(ring, x, y).alias("inside"))


@query("dataset_summary", "SELECT dataset, count(*) AS n, count(DISTINCT max_height) AS heights, min(max_height) AS low, max(max_height) AS high, list_sort(list(DISTINCT storeys::BIGINT))[1:8] AS labels FROM {d_parcels} GROUP BY dataset")
def dataset_summary(t):
    return G.dataset_summary(t.d_parcels)


_DATASETS = "SELECT p_partkey AS dataset_id, CASE p_partkey % 6 WHEN 5 THEN 'NOWHERE' ELSE n.r_name END AS municipality, '(' || (p_partkey % 2000) || ')' AS citation_label FROM {part} JOIN {region} n ON n.r_regionkey = p_partkey % 5"


def _datasets(t):
    k = F.col("p_partkey")
    return t.part.join(t.region, F.col("r_regionkey") == k % 5).select(k.alias("dataset_id"), F.when(k % 6 == 5, "NOWHERE").otherwise(F.col("r_name")).alias("municipality"), F.concat(F.lit("("), (k % 2000).cast("string"), F.lit(")")).alias("citation_label"))


_LINK = f"""WITH d AS ({_DATASETS}), l AS (SELECT document_id, citation_label, count(*) AS n, min(fragment_id) AS fragment_id FROM {{d_fragments}} GROUP BY ALL),
    j AS (SELECT dataset_id, r_regionkey::BIGINT AS document_id, n, fragment_id FROM d LEFT JOIN {{region}} r ON r.r_name = d.municipality LEFT JOIN l ON l.document_id = r.r_regionkey AND l.citation_label = d.citation_label),
    s AS (SELECT dataset_id, document_id, CASE WHEN n = 1 THEN fragment_id END AS fragment_id, CASE WHEN document_id IS NULL THEN 'no_document' WHEN n IS NULL THEN 'no_fragment' WHEN n > 1 THEN 'ambiguous' ELSE 'linked' END AS status FROM j)"""


def _linked(t):
    docs = t.region.select(F.col("r_regionkey").cast("long").alias("document_id"), F.col("r_name").alias("municipality"), F.col("r_regionkey").alias("ingested_at"))
    return G.dataset_link(_datasets(t), docs, t.d_fragments)


@query("dataset_link", _LINK + " SELECT * FROM s")
def dataset_link(t):
    return _linked(t)


_OLD = "SELECT *, CASE WHEN dataset_id % 3 = 0 THEN dataset_id END AS linked_fragment_id, CASE WHEN dataset_id % 7 = 1 THEN 'civic_address' END AS role"


def _old(t):
    """Datasets as an earlier run left them: a third linked, some with a role of their own."""
    k = F.col("dataset_id")
    return _datasets(t).withColumn("linked_fragment_id", F.when(k % 3 == 0, k)).withColumn("role", F.when(k % 7 == 1, "civic_address"))


@query("dataset_orphans", f"SELECT dataset_id, municipality FROM ({_OLD} FROM ({_DATASETS})) WHERE linked_fragment_id IS NULL AND role IS NULL")
def dataset_orphans(t):
    return G.dataset_orphans(_old(t)).select("dataset_id", "municipality")


@query("relink", _LINK + " SELECT * FROM s WHERE dataset_id % 3 <> 0 AND dataset_id % 7 <> 1")
def relink(t):
    docs = t.region.select(F.col("r_regionkey").cast("long").alias("document_id"), F.col("r_name").alias("municipality"), F.col("r_regionkey").alias("ingested_at"))
    return G.relink(_old(t), docs, t.d_fragments)


@query(
    "canonical_map",
    """SELECT event_id AS feature_id, user_id AS storeys, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS heritage, 'U' || user_id AS label,
        event_id % 4 >= 2 AS uncertain, CASE event_id % 4 WHEN 2 THEN ['heritage: missing'] WHEN 3 THEN ['heritage: not bool'] ELSE [] END AS warnings FROM {events}""",
)
def canonical_map(t):
    k = F.col("event_id")
    flag = F.when(k % 4 == 0, "yes").when(k % 4 == 1, "No").when(k % 4 == 2, "").otherwise("maybe")
    attrs = F.create_map(F.lit("ID"), F.col("user_id").cast("string"), F.lit("FLAG"), flag)
    config = {"storeys": {"from": "ID", "type": "int"}, "heritage": {"from": "FLAG", "type": "bool"}, "label": {"template": "U%s", "from": ["ID"]}}
    return G.canonical_map(t.events.select(k.alias("feature_id"), attrs.alias("attrs")), config)


@query(
    "coerce_value",
    "SELECT o_orderkey, try_cast(o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '.5' ELSE '' END AS DOUBLE) AS f, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS i, CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate::DATE END AS d, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS b, (TIMESTAMP '1970-01-01' + to_milliseconds(o_orderkey * 86400000))::DATE AS e FROM {orders}",
)
def coerce_value(t):
    k = F.col("o_orderkey")
    text = F.concat(k.cast("string"), F.when(k % 3 == 0, ".5").otherwise(""))
    return t.orders.select("o_orderkey", G.coerce_value(text, "float").alias("f"), G.coerce_value(text, "int").alias("i"), G.coerce_value(F.concat(F.col("o_orderdate").cast("date").cast("string"), F.when(k % 4 == 0, "xyz").otherwise("")), "date").alias("d"), G.coerce_value(F.when(k % 3 == 0, " Yes").when(k % 3 == 1, "n").otherwise("t"), "bool").alias("b"), G.coerce_value((k * 86400000).cast("string"), "epoch_ms_date").alias("e"))


_STREET = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(street), '\s+', ' ', 'g')), ' street$', ' st'), ' st\.$', ' st'), ' avenue$', ' ave'), ' road$', ' rd'), ' cres\.$', ' cres')"""


@query("normalize_street", f"SELECT address_id, {_STREET} AS street FROM {{d_addresses}}")
def normalize_street(t):
    return t.d_addresses.select("address_id", G.normalize_street(F.col("street")).alias("street"))


@query("reference_key", f"SELECT address_id, 'civic:' || civic_number || ' ' || {_STREET} AS key FROM {{d_addresses}}")
def reference_key(t):
    null = F.lit(None).cast("string")
    key = G.reference_key(F.lit("civic_address"), null, F.col("civic_number").cast("string"), F.col("street"), null, F.array().cast("array<string>"))
    return t.d_addresses.select("address_id", key.alias("key"))


@query(
    "resolve_location",
    f"""WITH a AS (SELECT address_id, 'civic:' || civic_number || ' ' || {_STREET} AS key FROM {{d_addresses}}),
        r AS (SELECT c_custkey AS question_id, 'civic:' || (c_custkey % 160) || ' barrington st' AS key FROM {{customer}}),
        c AS (SELECT DISTINCT 'civic:' || (s_suppkey % 30) || ' barrington st' AS key, CASE WHEN s_suppkey % 30 < 10 THEN NULL ELSE 1000000 + s_suppkey % 30 END AS address_id FROM {{supplier}}),
        f AS (SELECT key, min(address_id) AS found FROM a GROUP BY key)
        SELECT question_id, r.key, CASE WHEN c.key IS NOT NULL THEN c.address_id ELSE found END AS address_id,
               CASE WHEN c.key IS NOT NULL THEN CASE WHEN c.address_id IS NULL THEN 'cached_miss' ELSE 'cache' END WHEN found IS NOT NULL THEN 'address' ELSE 'miss' END AS layer
        FROM r LEFT JOIN c ON c.key = r.key LEFT JOIN f ON f.key = r.key""",
)
def resolve_location(t):
    null = F.lit(None).cast("string")
    key = G.reference_key(F.lit("civic_address"), null, F.col("civic_number").cast("string"), F.col("street"), null, F.array().cast("array<string>"))
    addresses = t.d_addresses.select("address_id", key.alias("key"))
    at = lambda n: F.concat(F.lit("civic:"), n.cast("string"), F.lit(" barrington st"))
    refs = t.customer.select(F.col("c_custkey").alias("question_id"), at(F.col("c_custkey") % 160).alias("key"))
    m = F.col("s_suppkey") % 30
    cache = t.supplier.select(at(m).alias("key"), F.when(m >= 10, m + 1000000).alias("address_id")).distinct()
    return G.resolve_locations(refs, cache, addresses)[0].select("question_id", "key", "address_id", "layer")


@query(
    "extract_locations",
    rf"""SELECT question_id, 'parcel_id' AS kind, unnest(regexp_extract_all(question, '{G.PARCEL}', 1)) AS parcel_id, NULL AS civic_number, NULL AS street, 1.0::DOUBLE AS confidence FROM {{d_inquiries}}
        UNION ALL SELECT question_id, 'civic_address', NULL, regexp_extract(raw, '^(\d+)', 1), regexp_replace(regexp_extract(raw, '^\d+\s+(.*)$', 1), '\.$', ''), 0.9::DOUBLE
        FROM (SELECT question_id, unnest(regexp_extract_all(question, '{G.CIVIC.replace(chr(39), chr(39) * 2)}')) AS raw FROM d_inquiries)""",
)
def extract_locations(t):
    return G.extract_locations(t.d_inquiries)


@query(
    "anchor_key",
    r"""SELECT address_id, civic_number || ' ' || trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(street), '\bstreet\b', 'st'), '\bavenue\b', 'ave'), '\broad\b', 'rd'), '[,.]', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM {d_addresses}""",
)
def anchor_key(t):
    label = F.concat(F.col("civic_number").cast("string"), F.lit(" "), F.col("street"), F.lit(" Apt 4, B3H 1A1, NS"))
    return t.d_addresses.select("address_id", G.anchor_key(F.regexp_replace(label, ", B3H 1A1, NS", " B3H 1A1, NS"), F.lit("address")).alias("key"))


@query(
    "corner_lot",
    "SELECT l_orderkey AS feature_id, coalesce(max(CASE WHEN l_quantity >= 9 THEN b END) - min(CASE WHEN l_quantity >= 9 THEN b END) BETWEEN 30 AND 150, false) AS corner FROM (SELECT *, (l_linenumber % 2) * 90.0 AS b FROM {lineitem}) GROUP BY l_orderkey",
)
def corner_lot(t):
    fronts = t.lineitem.select(F.col("l_orderkey").alias("feature_id"), F.col("l_quantity").alias("length_m"), ((F.col("l_linenumber") % 2) * 90.0).alias("bearing"))
    return G.corner_lot(fronts, buffer_m=8.0)


@query(
    "lot_facts",
    f"""WITH i AS ({_INSIDE}), f AS (SELECT a.address_id, min(i.feature_id) AS feature_id FROM d_addresses a LEFT JOIN i USING (address_id) GROUP BY a.address_id)
        SELECT address_id, f.feature_id, CASE WHEN f.feature_id IS NULL THEN 'no parcel at the address' END AS reason, round((x1 - x0) * 111320.0 * cos(radians((y0 + y1) / 2)) * (y1 - y0) * 111320.0, 2) AS area_m2
        FROM f LEFT JOIN d_parcels p ON p.feature_id = f.feature_id""",
)
def lot_facts(t):
    found = G.containing_parcel(t.d_addresses, t.d_parcels).join(G.lot_metrics(t.d_parcels), "feature_id", "left")
    return found.select("address_id", "feature_id", F.when(F.col("feature_id").isNull(), "no parcel at the address").alias("reason"), F.round("area_m2", 2).alias("area_m2"))


@query("lot_facts_block", "SELECT c_custkey AS feature_id, concat_ws(' ', 'segment=' || c_mktsegment, CASE WHEN c_custkey % 3 > 0 THEN 'nation=' || c_nationkey END) AS block FROM {customer}")
def lot_facts_block(t):
    facts = {"segment": F.col("c_mktsegment"), "nation": F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey"))}
    return t.customer.select(F.col("c_custkey").alias("feature_id"), G.lot_facts_block(facts).alias("block"))
