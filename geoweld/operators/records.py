"""Bringing sources into canonical columns, and rules over single records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweld.functions.text import first_present, semantic_null

# --- columns -------------------------------------------------------------------------------


def there(df: DataFrame) -> dict[str, str]:
    """The table's columns by their names in lower case."""
    return {c.lower(): c for c in df.columns}


def renamed(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """df with columns under their canonical names; mapping tells which column each is, empty ones are passed over.

    An error names the first column that doesn't exist.
    """
    wanted = {actual: name for name, actual in mapping.items() if actual}
    for actual, name in wanted.items():
        if actual not in df.columns:
            raise ValueError(f"there is no column {actual} for {name}")
    return df.withColumnsRenamed(wanted)


def required(df: DataFrame, columns: Sequence[str], defaults: Mapping[str, object]) -> DataFrame:
    """df, which must have columns, with those of defaults that it lacks."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """df with defaults where a column is missing or null."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with those of columns that it has as doubles, null where they aren't numbers."""
    return df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in columns if c in df.columns})


def laid_out(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """The columns of a deliverable in their order, name to type; null where df has none, other columns are left out."""
    known = there(df)
    return df.select(*((F.col(known[c.lower()]) if c.lower() in known else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()))


# --- profiles -------------------------------------------------------------------------------

#: For each kind of source: its canonical text columns, each with the columns it may come from in order of preference, its numeric
#: ones, and the kinds of geometry that it may hold.
PROFILES: dict[str, dict] = {
    "buildings": {"text": {"canonical_id": ["source_feature_id", "osm_id", "id", "fid"], "name": ["name", "full_name"], "category": ["fclass", "type", "class"]}, "number": {"height": ["height", "bld_h", "building_h"], "confidence": ["confidence", "score"]}, "kinds": ["polygon"]},
    "roads": {"text": {"canonical_id": ["osm_id", "id", "fid"], "name": ["name", "road_name"], "category": ["road_class", "fclass", "highway", "class"]}, "number": {}, "kinds": ["line"]},
    "waterways": {"text": {"canonical_id": ["osm_id", "hyriv_id", "id"], "name": ["name"], "category": ["fclass", "waterway"]}, "number": {"order": ["ord_stra", "order"]}, "kinds": ["line"]},
    "water": {"text": {"canonical_id": ["osm_id", "hylak_id", "id"], "name": ["name", "lake_name"], "category": ["fclass", "water"]}, "number": {"area": ["lake_area", "area"]}, "kinds": ["polygon"]},
    "places": {"text": {"canonical_id": ["source_feature_id", "osm_id", "ufi", "id"], "name": ["name", "full_name", "full_nm_nd"], "category": ["category", "desig_cd", "fclass", "type"]}, "number": {"lon": ["lon", "long", "longitude"], "lat": ["lat", "latitude"]}, "kinds": ["point"]},
}


def profiled(df: DataFrame, profile: Mapping[str, Mapping], source: str) -> DataFrame:
    """The profile's columns, source_id and the geometry of the rows of its kinds.

    A text comes from the first of its columns that has a value in the row, a number from the first that holds one. Columns
    kind, parts, members and bounds are kept where df has them.
    """
    known = there(df)
    of = lambda names: [F.col(known[n.lower()]) for n in names if n.lower() in known]
    made = [(first_present(*of(names)) if of(names) else F.lit(None).cast("string")).alias(c) for c, names in profile["text"].items()]
    for c, names in profile["number"].items():
        found = [x.cast("string").try_cast("double") for x in of(names)]
        made.append((F.coalesce(*found) if found else F.lit(None).cast("double")).alias(c))
    shape = [known[c] for c in ("kind", "parts", "members", "minx", "miny", "maxx", "maxy") if c in known]
    rows = df.where(F.col(known["kind"]).isin(*profile["kinds"])) if "kind" in known else df
    return rows.select(*made, F.lit(source).alias("source_id"), *shape)


def by_priority(sources: Sequence[tuple[str, DataFrame]], area: str, least: float) -> DataFrame:
    """The rows of all sources of at least that area, with source_name and source_rank, their place in the list."""
    tagged = [df.where(F.col(area) >= least).withColumns({"source_name": F.lit(name), "source_rank": F.lit(i)}) for i, (name, df) in enumerate(sources)]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def checked_reference(df: DataFrame, area: Column, lon: Column, lat: Column) -> DataFrame:
    """df of reference buildings with confidence (1 where it isn't within 0 to 1), area_in_me, longitude and latitude filled from the shape."""
    own = lambda c: F.col(c).cast("string").try_cast("double") if c in df.columns else F.lit(None).cast("double")
    confidence = own("confidence")
    return df.withColumns({
        "confidence": F.when(confidence.between(0.0, 1.0), confidence).otherwise(1.0),
        "area_in_me": F.coalesce(own("area_in_me"), area), "longitude": F.coalesce(own("longitude"), lon), "latitude": F.coalesce(own("latitude"), lat),
    })


def with_provenance(df: DataFrame, source: str) -> DataFrame:
    """df with source_id where it is missing or blank, and canonical_id (source:id), canonical_name and canonical_category where it lacks these columns.

    Each comes from the first column that df has of those that may hold it. Without any id column a digest of the row is one; without
    the others the text is empty.
    """
    known = there(df)
    pick = lambda *names: next((F.col(known[n]).cast("string") for n in names if n in known), None)
    said = pick("source_id")
    own = pick("source_feature_id", "osm_id", "ufi", "uni", "id", "poi_id")
    made = {
        "canonical_id": F.concat(F.lit(f"{source}:"), F.xxhash64(*df.columns).cast("string") if own is None else own),
        "canonical_name": pick("name", "full_name", "full_nm_nd"), "canonical_category": pick("category", "desig_cd", "generic", "fclass", "type"),
    }
    out = df.withColumn("source_id", F.lit(source) if said is None else F.when(F.trim(said) != "", said).otherwise(F.lit(source)))
    return out.withColumns({c: F.lit("") if x is None else x for c, x in made.items() if c not in known})


def named_only(df: DataFrame, name: str = "name") -> DataFrame:
    """The rows that have a name."""
    return df.where(F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) != "")


def canonical_roads(df: DataFrame) -> DataFrame:
    """df with fusion_source, match_role, supplement_segment_id, road_class and road_name.

    df: layer (base or supplement), residual (boolean), segment_id, original_id, residual_part and any of road_class,
    fclass, highway, class and name. The last of the class columns that has a value counts.
    """
    supplement, residual = F.col("layer") == "supplement", F.coalesce(F.col("residual"), F.lit(False))
    own = semantic_null(F.col("original_id").cast("string"))
    with_part = F.concat(own, F.lit("_res"), F.coalesce(F.col("residual_part").cast("string").try_cast("double").cast("int"), F.lit(1)).cast("string"))
    segment = F.coalesce(F.when(residual, with_part).otherwise(own), F.col("segment_id").cast("string"), F.lit(""))
    classes = [F.col(c) for c in ("class", "highway", "fclass", "road_class") if c in df.columns]
    return df.withColumns({
        "fusion_source": F.when(supplement & residual, "supplement_residual").when(supplement, "supplement_road").otherwise("base_road_network"),
        "match_role": F.when(supplement & residual, "supplement_uncovered_residual").when(supplement, "supplement_unmatched").otherwise("base"),
        "supplement_segment_id": F.when(supplement, segment).otherwise(""), "road_class": F.coalesce(*classes, F.lit("road")),
        "road_name": F.coalesce(semantic_null(F.col("name")), F.lit("")) if "name" in df.columns else F.lit(""),
    })


def split_by_similarity(df: DataFrame, least: Mapping[str, float]) -> tuple[DataFrame, DataFrame]:
    """The rows that reach every bound, and those below any; a row with a NaN that is below none belongs to neither, a null counts as NaN."""
    value = {c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in least}
    reach = [~F.isnan(value[c]) & (value[c] >= t) for c, t in least.items()]
    below = [~F.isnan(value[c]) & (value[c] < t) for c, t in least.items()]
    every, some = reach[0], below[0]
    for a, b in zip(reach[1:], below[1:], strict=True):
        every, some = every & a, some | b
    return df.where(every), df.where(some)


def match_label(similarity: Column, bound: float) -> Column:
    """"1" above the bound, else null."""
    return F.when(similarity > bound, "1")


def carried(relation: Column, own: Column, other: Column, mean_of_others: Column, n_others: Column, most: int = 3) -> Column:
    """A height by the class of a relation: the partner's for 1:1 and N:1, the mean of them for 1:N unless there are more than most, else the own."""
    many = F.when(n_others <= most, mean_of_others)
    return F.when(relation.isin("1:1", "N:1"), F.coalesce(other, own)).when(relation == "1:N", F.coalesce(many, own)).otherwise(own)


# --- heights -------------------------------------------------------------------------------

#: Columns of a layer that may hold its height, in order of preference. Fixed values.
HEIGHT_COLUMNS = ("height", "height_output", "height_fused", "height_vector_fused", "h_raster", "height_raster", "building_h", "bld_h")
#: Sources whose height column has a name of its own. Fixed values.
HEIGHT_OF_SOURCE = {"OPENBUILDINGMAP": "height_obm"}


def height_column(source: Column) -> Column:
    """The name of a source's height column: height_ and its letters and digits, other characters as one underscore."""
    key = F.regexp_replace(F.regexp_replace(F.upper(source), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    named = F.coalesce(*(F.when(key == k, v) for k, v in HEIGHT_OF_SOURCE.items()))
    return F.coalesce(named, F.when(key == "", "height_unknown").otherwise(F.concat(F.lit("height_"), F.lower(key))))


def first_height_column(columns: Sequence[str]) -> str | None:
    """Which of a layer's columns holds its height."""
    known = {c.lower(): c for c in columns}
    return next((known[c] for c in HEIGHT_COLUMNS if c in known), None)


def final_height(raster: Column, vectors: Mapping[str, Column], fallback: float = 0.0) -> Column:
    """A struct of height and source: the raster's if positive, else the largest positive vector height, of equals the first, else the fallback."""
    positive = lambda c: F.when((c > 0) & ~F.isnan(c), c)
    best = F.greatest(*(positive(c) for c in vectors.values())) if len(vectors) > 1 else positive(next(iter(vectors.values())))
    of = F.coalesce(*(F.when(positive(c) == best, F.lit(name)) for name, c in vectors.items()))
    own = positive(raster)
    return F.struct(F.coalesce(own, best, F.lit(fallback)).alias("height"), F.when(own.isNotNull(), "raster").otherwise(F.coalesce(of, F.lit("fallback"))).alias("source"))


def height_semantics(name: Column, columns: Column, band: Column) -> Column:
    """What a source's heights mean: estimated_height, presence_only or unknown."""
    name, band = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(band, F.lit("")))
    says = lambda w: band.contains(w) | name.contains(w)
    return F.when(F.exists(columns, lambda c: F.lower(c) == "height"), "estimated_height").when(says("presence"), "presence_only").when(says("height"), "estimated_height").otherwise("unknown")


# --- record rules ----------------------------------------------------------------------------


def attribute_agreement(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """The share of attributes whose values agree, of those that both sides have; null if there are none."""
    from geoweld.functions.text import normalized

    both = [(normalized(a.cast("string")), normalized(b.cast("string"))) for a, b in pairs]
    known = [(a != "") & (b != "") for a, b in both]
    compared = sum((k.cast("int") for k in known), F.lit(0))
    agreed = sum((F.when(k, (a == b).cast("int")).otherwise(0) for k, (a, b) in zip(known, both, strict=True)), F.lit(0))
    return F.when(compared > 0, agreed / compared)


def first_category(text: Column) -> Column:
    """The first of a JSON list, or of a list with commas; "poi" for none."""
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    listed = F.get(F.from_json(F.when(trimmed.startswith("[") & trimmed.endswith("]"), trimmed), "array<string>"), 0)
    plain = F.trim(F.split(trimmed, ",")[0])
    return F.when(trimmed.isin("", "<NA>"), "poi").otherwise(F.coalesce(listed, F.when(plain != "", plain), F.lit("poi")))


def failure_tokens(summary: Column) -> Column:
    """key=value parts of a text between pipes as a map with keys in lower case; the last of a key counts."""
    parts = F.filter(F.transform(F.split(F.coalesce(summary, F.lit("")), r"\|"), lambda p: F.trim(p)), lambda p: p.contains("="))
    key = lambda p: F.lower(F.trim(F.substring_index(p, "=", 1)))
    value = lambda p: F.trim(F.regexp_replace(p, "^[^=]*=", ""))
    good = F.filter(parts, lambda p: (key(p) != "") & (value(p) != ""))
    last = F.filter(good, lambda p, i: ~F.exists(F.slice(good, i + 2, F.size(good)), lambda q: key(q) == key(p)))
    return F.map_from_arrays(F.transform(last, key), F.transform(last, value))


def coverage_status(count: Column) -> Column:
    return F.when(count.isNull(), "unknown").when(count == 0, "empty").otherwise("available")


def degradation(coverage: DataFrame, key: str, external: Sequence[str], system: Sequence[str]) -> DataFrame:
    """key, level, available, missing: how the sources of each component stand.

    coverage: key, source, status, n, fault and outside (boolean). A source is available if it says so or has rows. With a missing source the level is
    system_failure if a fault is one of system, external_uncontrollable if all missing ones are outside or have a fault of external, else partial_source.
    """
    fine = (F.lower(F.trim(F.coalesce("status", F.lit("")))) == "available") | (F.coalesce("n", F.lit(0)) > 0)
    fault = F.upper(F.trim(F.coalesce("fault", F.lit(""))))
    far = F.coalesce("outside", F.lit(False)) | fault.isin(*external)
    named = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("source"))))
    counted = coverage.groupBy(key).agg(
        named(fine).alias("available"), named(~fine).alias("missing"), F.count_if(~fine).alias("gone"), F.count_if(~fine & far).alias("far"), F.count_if(~fine & fault.isin(*system)).alias("broken")
    )
    level = F.when(F.col("gone") == 0, "none").when(F.col("broken") > 0, "system_failure").when(F.col("far") == F.col("gone"), "external_uncontrollable").otherwise("partial_source")
    return counted.select(key, level.alias("level"), "available", "missing")


def readiness(required_ids: Column, available: Column, outside: Column) -> Column:
    """Whether a job may run by itself: required, available and outside (not for us to mend) are arrays of sources."""
    missing = F.array_except(required_ids, available)
    return F.when(F.size(missing) == 0, "full_autonomous_closure").when(F.size(F.array_except(missing, outside)) == 0, "degraded_external").otherwise("system_failure")


def out_of_range(parameters: DataFrame, specs: DataFrame) -> DataFrame:
    """parameter rows (name, value) that break their spec (name, low, high, needed), with `problem`: missing, below or above."""
    joined = specs.join(parameters, "name", "left")
    problem = F.when(F.col("value").isNull() & F.col("needed"), "missing").when(F.col("value") < F.col("low"), "below").when(F.col("value") > F.col("high"), "above")
    return joined.withColumn("problem", problem).where("problem IS NOT NULL")


def effective_parameters(specs: DataFrame, conditions: DataFrame, overrides: DataFrame, contexts: DataFrame) -> DataFrame:
    """context, name, value, origin: an override if there is one, else the first condition that holds, else the default.

    specs: name, value. conditions: name, place, value, bucket, country, sources (null asks nothing; a condition that asks nothing never
    holds). overrides: name, value. contexts: context, bucket, country, sources (array). Specs and conditions are a catalog's, of bounded size.
    """
    asks = F.expr("bucket IS NOT NULL OR country IS NOT NULL OR sources IS NOT NULL")
    c = F.broadcast(conditions.where(asks)).alias("c")
    holds = (
        (F.col("c.bucket").isNull() | (F.col("c.bucket") == F.col("x.bucket")))
        & (F.col("c.country").isNull() | (F.lower("c.country") == F.lower("x.country")))
        & (F.col("c.sources").isNull() | (F.size(F.array_except("c.sources", F.coalesce("x.sources", F.array().cast("array<string>")))) == 0))
    )
    hit = contexts.alias("x").join(c, holds).groupBy("context", "name").agg(F.min_by("value", "place").alias("conditional"))
    every = contexts.select("context").crossJoin(F.broadcast(specs.withColumnRenamed("value", "default")))
    own = overrides.select("name", F.col("value").alias("override"), F.lit(True).alias("known"))
    made = every.join(hit.withColumn("held", F.lit(True)), ["context", "name"], "left").join(F.broadcast(own), "name", "left")
    origin = F.when(F.col("known"), "durable_learning").when(F.col("held"), "conditional_default").otherwise("static_seed")
    value = F.when(F.col("known"), F.col("override")).when(F.col("held"), F.col("conditional")).otherwise(F.col("default"))
    return made.select("context", "name", value.alias("value"), origin.alias("origin"))


def non_building(name: Column, height: Column, pattern: str, allowed: str, floor: float = 2.5) -> Column:
    """True for a low record whose name says that it is no building; names on the allowed list stay."""
    text = F.lower(F.coalesce(name, F.lit("")))
    return text.rlike(pattern) & ~text.rlike(allowed) & (F.coalesce(height, F.lit(0.0)) < floor)


def like_filter(column: str, words: Sequence[str]) -> str:
    """SQL that holds for texts with any of the words in whatever case; nothing holds for no words."""
    quoted = (w.lower().replace("'", "''").replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") for w in words)
    return " OR ".join(f"lower({column}) LIKE '%{w}%'" for w in quoted) or "false"


def semantic_hash(columns: Sequence[Column]) -> Column:
    """SHA-256 of the values as JSON, null ones included, whatever their order in the table."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def box_hash(box: Sequence[Column], digits: int = 7) -> Column:
    """SHA-1 of a rounded box."""
    return F.sha1(F.concat_ws(",", *(F.format_string(f"%.{digits}f", c) for c in box)))


def projected(df: DataFrame, without: Sequence[str] = (), rounded: dict[str, int] | None = None, filled: dict[str, object] | None = None) -> DataFrame:
    """df without some columns, with others rounded to so many digits and nulls of others filled; columns it lacks, in whatever case, are no error."""
    gone = {c.lower() for c in without}
    digits, fill = ({k.lower(): v for k, v in (x or {}).items()} for x in (rounded, filled))
    out = []
    for c in df.columns:
        if c.lower() not in gone:
            made = F.col(f"`{c}`")
            made = F.round(made, digits[c.lower()]) if c.lower() in digits else made
            out.append((F.coalesce(made, F.lit(fill[c.lower()])) if c.lower() in fill else made).alias(c))
    return df.select(*out)


def location_of(text: Column, ends: Sequence[str] = ("please", "with", "using", "for")) -> Column:
    """The place that follows "in" or "of" in a request, up to punctuation or one of the words after which it ends; null if there is none."""
    stop = "|".join(ends)
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?i)\b(?:in|of)\s+([A-Za-z][A-Za-z' -]*?)(?=\s+(?:{stop})\b|[,.;!?]|$)", 1)), F.lit(""))
