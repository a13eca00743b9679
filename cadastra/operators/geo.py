"""Geo features and locations: canonical attributes, grid-keyed spatial joins, lot metrics, address resolution."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Degrees of a grid cell; joins meet on cells, then test exactly.
CELL = 0.005
EARTH_M = 111_320.0
# Street suffixes.
SUFFIXES = {
    "street": "st", "st.": "st", "avenue": "ave", "ave.": "ave", "road": "rd", "rd.": "rd", "boulevard": "blvd", "blvd.": "blvd",
    "drive": "dr", "dr.": "dr", "lane": "ln", "ln.": "ln", "crescent": "cres", "cres.": "cres", "court": "ct", "ct.": "ct",
    "place": "pl", "pl.": "pl", "highway": "hwy", "hwy.": "hwy", "parkway": "pkwy", "pkwy.": "pkwy", "terrace": "terr", "terr.": "terr",
}


def coerce_value(c: Column, kind: str) -> Column:
    """A string as the canonical type; null where it does not fit."""
    text = F.trim(c)
    if kind == "float":
        return text.try_cast("double")
    if kind == "int":
        return text.try_cast("bigint")
    if kind == "bool":
        low = F.lower(text)
        return F.when(low.isin("true", "yes", "y", "1"), True).when(low.isin("false", "no", "n", "0"), False)
    if kind == "date":
        return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
    if kind == "rfc2822_date":
        return F.try_to_timestamp(F.regexp_replace(text, r"^[A-Za-z]{3},\s*|\s+(GMT|UTC|[+-]\d{4})$", ""), F.lit("d MMM yyyy HH:mm:ss")).cast("date")
    if kind == "epoch_ms_date":
        return F.timestamp_millis(text.try_cast("bigint")).cast("date")
    return F.nullif(text, F.lit(""))


def canonical_map(features: DataFrame, config: Mapping[str, Mapping]) -> DataFrame:
    """``features`` (feature_id, attrs map) as canonical columns, plus uncertain and warnings.

    ``config`` maps a field to from / type / optional / null_when / template. Blank values and those
    in null_when are missing; a required field that is missing or does not fit is a warning.
    """
    columns, warnings = [], []
    for field, rule in config.items():
        if "template" in rule:
            columns.append(F.format_string(rule["template"], *[F.col("attrs")[a] for a in rule["from"]]).alias(field))
            continue
        raw = F.nullif(F.trim(F.col("attrs")[rule["from"]]), F.lit(""))
        for bad in rule.get("null_when", ()):
            raw = F.nullif(raw, F.lit(bad))
        value = coerce_value(raw, rule["type"])
        columns.append(value.alias(field))
        if not rule.get("optional"):
            warnings.append(F.when(raw.isNull(), F.lit(f"{field}: missing")).when(value.isNull(), F.lit(f"{field}: not {rule['type']}")))
    said = F.array_compact(F.array(*warnings)) if warnings else F.array().cast("array<string>")
    return features.select("feature_id", *columns, (F.size(said) > 0).alias("uncertain"), said.alias("warnings"))


def ring_bbox(ring: Column) -> Column:
    """struct(x0, y0, x1, y1) of an array of struct(x, y)."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a ring (first point not repeated): crossings of a ray are odd."""
    n = F.size(ring)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, (i + 1) % n).alias("b")))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        return spans & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(spans, b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def ring_area(ring: Column) -> Column:
    """Shoelace area of a ring."""
    n = F.size(ring)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ring, i)["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * F.get(ring, i)["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)) / 2


def _cells(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, cell: float) -> DataFrame:
    axis = lambda lo, hi: F.sequence(F.floor(lo / cell), F.floor(hi / cell))
    return df.withColumn("gx", F.explode(axis(x0, x1))).withColumn("gy", F.explode(axis(y0, y1)))


def boxes_with_points(points: DataFrame, boxes: DataFrame, cell: float = CELL) -> DataFrame:
    """Points (x, y) with the half-open boxes (x0 … y1) that hold them: an equi-join on grid cells, then the test."""
    at = points.withColumn("gx", F.floor(F.col("x") / cell)).withColumn("gy", F.floor(F.col("y") / cell))
    spread = _cells(boxes, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), cell)
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    return at.join(spread, ["gx", "gy"]).where(inside).drop("gx", "gy")


def containing_parcel(points: DataFrame, parcels: DataFrame, key: str = "address_id") -> DataFrame:
    """Each point's first parcel by id, null where none holds it."""
    hit = boxes_with_points(points, parcels).groupBy(key).agg(F.min("feature_id").alias("feature_id"))
    return points.select(key).join(hit, key, "left")


def spatial_match(locations: DataFrame, features: DataFrame, cell: float = CELL) -> DataFrame:
    """Boxes against boxes: overlap area, whether the location contains the feature; a pair counts once.

    Both sides go to their grid cells; a pair is made only in the first cell that both share.
    """
    named = lambda df, p: df.select(*[F.col(c).alias(f"{p}{c}") if c in ("x0", "y0", "x1", "y1") else F.col(c) for c in df.columns])
    a, b = named(locations, "a"), named(features, "b")
    left = _cells(a, F.col("ax0"), F.col("ay0"), F.col("ax1"), F.col("ay1"), cell)
    right = _cells(b, F.col("bx0"), F.col("by0"), F.col("bx1"), F.col("by1"), cell)
    width = F.least("ax1", "bx1") - F.greatest("ax0", "bx0")
    height = F.least("ay1", "by1") - F.greatest("ay0", "by0")
    first = (F.col("gx") == F.greatest(F.floor(F.col("ax0") / cell), F.floor(F.col("bx0") / cell))) & (F.col("gy") == F.greatest(F.floor(F.col("ay0") / cell), F.floor(F.col("by0") / cell)))
    pairs = left.join(right, ["gx", "gy"]).where(first & (width > 1e-12) & (height > 1e-12))
    contains = (F.col("ax0") <= F.col("bx0")) & (F.col("ay0") <= F.col("by0")) & (F.col("ax1") >= F.col("bx1")) & (F.col("ay1") >= F.col("by1"))
    return pairs.withColumn("overlap", width * height).withColumn("contains", contains).drop("gx", "gy")


def nearby_lines(parcels: DataFrame, lines: DataFrame, pad: float = 0.001, cell: float = CELL) -> DataFrame:
    """(feature_id, line_id) of lines whose box meets the padded box of a parcel."""
    padded = parcels.select("feature_id", (F.col("x0") - pad).alias("x0"), (F.col("y0") - pad).alias("y0"), (F.col("x1") + pad).alias("x1"), (F.col("y1") + pad).alias("y1"))
    a = _cells(padded, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), cell)
    b = _cells(lines.select("line_id", *[F.col(c).alias(f"l{c}") for c in ("x0", "y0", "x1", "y1")]), F.col("lx0"), F.col("ly0"), F.col("lx1"), F.col("ly1"), cell)
    meets = (F.col("x0") <= F.col("lx1")) & (F.col("x1") >= F.col("lx0")) & (F.col("y0") <= F.col("ly1")) & (F.col("y1") >= F.col("ly0"))
    return a.join(b, ["gx", "gy"]).where(meets).select("feature_id", "line_id").distinct()


def multi_unit(parcels: DataFrame, addresses: DataFrame | None) -> DataFrame:
    """Parcels with whether two or more address points lie in them; null without addresses."""
    if addresses is None:
        return parcels.select("feature_id", F.lit(None).cast("boolean").alias("multi_unit"))
    counts = boxes_with_points(addresses, parcels).groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"))
    return parcels.select("feature_id").join(counts, "feature_id", "left").select("feature_id", (F.coalesce("n", F.lit(0)) >= 2).alias("multi_unit"))


def lot_metrics(parcels: DataFrame) -> DataFrame:
    """Area, perimeter and box sides in metres, in a local projection at each lot's own latitude."""
    lat = F.radians((F.col("y0") + F.col("y1")) / 2)
    w = (F.col("x1") - F.col("x0")) * EARTH_M * F.cos(lat)
    h = (F.col("y1") - F.col("y0")) * EARTH_M
    return parcels.select("feature_id", w.alias("width_m"), h.alias("height_m"), (w * h).alias("area_m2"), (2 * (w + h)).alias("perimeter_m"))


def corner_lot(fronts: DataFrame, buffer_m: float = 8.0) -> DataFrame:
    """Lots with two frontage pieces of 1.1 buffers or more whose bearings differ by 30 degrees or more, modulo 180.

    ``fronts``: feature_id, length_m, bearing. The widest gap between sorted bearings on the half
    circle decides, so pieces are not compared in pairs.
    """
    kept = fronts.where(F.col("length_m") >= 1.1 * buffer_m).groupBy("feature_id").agg(F.array_sort(F.collect_set(F.pmod(F.col("bearing"), F.lit(180.0)))).alias("b"))
    n = F.size("b")
    spread = F.exists("b", lambda x: F.exists("b", lambda y: F.least(F.abs(x - y), 180 - F.abs(x - y)) >= 30))
    return fronts.select("feature_id").distinct().join(kept, "feature_id", "left").select("feature_id", F.coalesce((n >= 2) & spread, F.lit(False)).alias("corner"))


def lot_facts_block(facts: Mapping[str, Column]) -> Column:
    """key=value pairs in a fixed order, without what is null."""
    return F.concat_ws(" ", *[F.when(c.isNotNull(), F.concat(F.lit(f"{k}="), c.cast("string"))) for k, c in facts.items()])


def dataset_summary(features: DataFrame) -> DataFrame:
    """Count, span of a measure and the first eight distinct labels of each dataset."""
    return features.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("max_height").alias("heights"), F.min("max_height").alias("low"), F.max("max_height").alias("high"), F.slice(F.array_sort(F.collect_set(F.col("storeys").cast("long"))), 1, 8).alias("labels"))


def dataset_link(datasets: DataFrame, documents: DataFrame, fragments: DataFrame) -> DataFrame:
    """Datasets with their document (the newest of their place) and the one fragment with their label."""
    newest = documents.groupBy("municipality").agg(F.max_by("document_id", "ingested_at").alias("document_id"))
    labels = fragments.groupBy("document_id", "citation_label").agg(F.count(F.lit(1)).alias("n"), F.min("fragment_id").alias("fragment_id"))
    joined = datasets.join(newest, "municipality", "left").join(labels, ["document_id", "citation_label"], "left")
    status = F.when(F.col("document_id").isNull(), "no_document").when(F.col("n").isNull(), "no_fragment").when(F.col("n") > 1, "ambiguous").otherwise("linked")
    return joined.select("dataset_id", "document_id", F.when(F.col("n") == 1, F.col("fragment_id")).alias("fragment_id"), status.alias("status"))


def dataset_orphans(datasets: DataFrame) -> DataFrame:
    """Datasets (linked_fragment_id, role) without a fragment that have no role of their own."""
    return datasets.where("linked_fragment_id is null and role is null")


def relink(datasets: DataFrame, documents: DataFrame, fragments: DataFrame) -> DataFrame:
    """What ``dataset_link`` gives for the orphans among ``datasets`` now, after documents or fragments came."""
    return dataset_link(dataset_orphans(datasets), documents, fragments)


def normalize_street(c: Column) -> Column:
    """Lower-cased, white space collapsed, the suffix in its short form."""
    text = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    last = F.regexp_extract(text, r"(\S+)$", 1)
    short = F.lit(None).cast("string")
    for long, s in SUFFIXES.items():
        short = F.when(last == long, s).otherwise(short)
    return F.when(short.isNotNull(), F.concat(F.regexp_replace(text, r"\S+$", ""), short)).otherwise(text)


def reference_key(kind: Column, parcel: Column, number: Column, street: Column, name: Column, streets: Column) -> Column:
    """Cache key of a location reference."""
    return (
        F.when(kind == "parcel_id", F.concat(F.lit("pid:"), F.trim(F.coalesce(parcel, F.lit("")))))
        .when(kind == "civic_address", F.concat(F.lit("civic:"), F.trim(F.concat_ws(" ", F.lower(F.trim(F.coalesce(number, F.lit("")))), normalize_street(street)))))
        .when(kind == "named_place", F.concat(F.lit("named:"), F.lower(F.trim(F.coalesce(name, F.lit(""))))))
        .when(kind == "intersection", F.concat(F.lit("intersection:"), F.array_join(F.array_sort(F.transform(streets, normalize_street)), "|")))
    )


# Patterns of civic addresses and parcel ids.
CIVIC = (
    r"(?i)\b(\d{1,5})\s+([A-Z][A-Za-z'.-]+(?:\s+[A-Z][A-Za-z'.-]+){0,3})"
    r"\s+(St(?:reet)?|Ave(?:nue)?|Rd|Road|Blvd|Boulevard|Dr(?:ive)?|Ln|Lane|Way|Cres(?:cent)?|Pl(?:ace)?|Ct|Court|Hwy|Highway|Pkwy|Parkway|Terr(?:ace)?)\b\.?"
)
PARCEL = r"(?i)\bPID[:\s]+(\d{6,12})\b"


def extract_locations(questions: DataFrame) -> DataFrame:
    """Location references of each question: parcel ids (1.0) and civic addresses (0.9)."""
    pid = questions.select("question_id", F.explode(F.regexp_extract_all("question", F.lit(PARCEL), F.lit(1))).alias("value"))
    ids = pid.select("question_id", F.lit("parcel_id").alias("kind"), F.col("value").alias("parcel_id"), F.lit(None).cast("string").alias("civic_number"), F.lit(None).cast("string").alias("street"), F.lit(1.0).alias("confidence"))
    raw = questions.select("question_id", F.explode(F.regexp_extract_all("question", F.lit(CIVIC), F.lit(0))).alias("raw"))
    civic = raw.select("question_id", F.lit("civic_address").alias("kind"), F.lit(None).cast("string").alias("parcel_id"), F.regexp_extract("raw", r"^(\d+)", 1).alias("civic_number"), F.regexp_replace(F.regexp_extract("raw", r"^\d+\s+(.*)$", 1), r"\.$", "").alias("street"), F.lit(0.9).alias("confidence"))
    return ids.unionByName(civic)


def resolve_locations(refs: DataFrame, cache: DataFrame, addresses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, cache): cache hits first (misses are cached too), then address features by number and street.

    ``refs`` and ``cache`` have key; ``addresses`` key and address_id, of which the smallest counts.
    """
    keys = refs.select("key").distinct()
    known = cache.select("key", F.col("address_id").alias("cached"), F.lit(True).alias("hit"))
    features = addresses.groupBy("key").agg(F.min("address_id").alias("found"))
    joined = keys.join(known, "key", "left").join(features, "key", "left")
    layer = F.when(F.col("hit"), F.when(F.col("cached").isNull(), "cached_miss").otherwise("cache")).when(F.col("found").isNotNull(), "address").otherwise("miss")
    resolved = joined.select("key", F.when(F.coalesce("hit", F.lit(False)), F.col("cached")).otherwise(F.col("found")).alias("address_id"), layer.alias("layer"))
    added = resolved.where("layer in ('address', 'miss')").select("key", "address_id")
    return refs.join(resolved, "key"), cache.select("key", "address_id").unionByName(added)


def anchor_key(label: Column, kind: Column) -> Column:
    """Match key of a case anchor: an address without accents, postal code, unit and province; a project as a slug."""
    plain = F.lower(F.trim(F.translate(label, "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyy")))
    address = plain
    for pattern in (r"\b[a-z]\d[a-z]\s*\d[a-z]\d\b", r"\b(?:apt|apartment|unit|suite|ste)\s*[\w-]+", r"#\s*[\w-]+", r",\s*(?:ns|nova\s*scotia|ontario|on|bc|british\s*columbia|alberta|ab|quebec|qc|canada|ca)\s*$"):
        address = F.regexp_replace(address, pattern, "")
    for long, s in (("street", "st"), ("avenue", "ave"), ("road", "rd"), ("drive", "dr"), ("boulevard", "blvd")):
        address = F.regexp_replace(address, rf"\b{long}\b", s)
    address = F.trim(F.regexp_replace(F.regexp_replace(address, "[,.]", " "), r"\s+", " "))
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9-]+", "-"), r"-+", "-"), r"^-+|-+$", "")
    return F.when(kind == "address", address).when(kind.isin("project_ref", "development_application"), slug).otherwise(F.trim(F.regexp_replace(plain, r"\s+", " ")))


