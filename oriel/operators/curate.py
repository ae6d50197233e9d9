"""Curation of source tables and reviewed sets: audits, provenance, seeding from constants, merging, choosing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oriel.functions.expressions import is_blank, stem
from oriel.functions.geometry import denormalised, polygon_error
from oriel.operators.validate import all_errors, require

# States of a labelled image in an audit.
NO_LABEL, LABELLED, EMPTY = "no_json_needs_presence_review", "labeled_needs_visual_review", "explicit_empty_needs_review"


def label_audit(images: DataFrame, labels: DataFrame, protected: DataFrame) -> DataFrame:
    """One row per image: filename, status, shape_count and issues, in order.

    ``images`` has filename, sha256, width and height; ``labels`` has filename, image_path, label_width, label_height and
    shapes (array of shape_type and points); ``protected`` has sha256. Of images of the same content the first by name
    is no duplicate.
    """
    first = Window.partitionBy("sha256").orderBy("filename")
    known = protected.select("sha256", F.lit(True).alias("_protected")).distinct()
    x = images.withColumn("_copy", F.row_number().over(first) > 1).join(known, "sha256", "left").join(labels, "filename", "left")
    has = F.col("shapes").isNotNull()
    faults = F.transform("shapes", lambda s: F.when(s["shape_type"] != "polygon", "non_polygon").otherwise(polygon_error(s["points"], F.col("width"), F.col("height"))))
    rules = [
        ("duplicate_or_protected", F.col("_copy") | F.coalesce("_protected", F.lit(False))),
        ("dimensions", has & ((F.col("label_width") != F.col("width")) | (F.col("label_height") != F.col("height")))),
        ("image_path", has & (F.col("image_path") != F.col("filename"))),
        ("shapes", has & F.exists(faults, lambda f: f.isNotNull())),
    ]
    status = F.when(~has, NO_LABEL).when(F.size("shapes") == 0, EMPTY).otherwise(LABELLED)
    return x.select("filename", status.alias("status"), F.coalesce(F.size("shapes"), F.lit(0)).alias("shape_count"), all_errors(rules).alias("issues"))


def provenance(sources: DataFrame, known_host: str = "wikimedia.org", dark_words: tuple[str, ...] = ("malam", "night")) -> DataFrame:
    """Intake columns of source rows (filename, title, source, license, artist): blanks get defaults, the permission holds
    licence and source, the notes title and artist."""
    given = lambda c, default: F.when(is_blank(c), F.lit(default) if isinstance(default, str) else default).otherwise(F.col(c))
    title, source = given("title", F.col("filename")), given("source", "unknown_source")
    dark = reduce(lambda a, b: a | b, (F.lower(title).contains(w) for w in dark_words))
    return sources.select(
        F.col("filename").alias("source_path"),
        F.when(source.contains(known_host), "wikimedia_commons").otherwise("curated_source").alias("source_name"),
        F.concat(given("license", "license_unknown"), F.lit("; "), source).alias("usage_permission"),
        F.when(dark, "low_light").otherwise("normal_or_unknown").alias("lighting"),
        F.concat(title, F.lit("; artist="), F.coalesce("artist", F.lit("unknown"))).alias("notes"),
    )


#: What the metadata of published photos say where nothing is known.
PUBLISHED = {"device_model": "unknown_published_image", "camera_position": "varied_published_photo", "motion": "static_photo", "surface": "mixed", "dataset_task": "tactile"}


def labelled_dataset(sources: DataFrame, images: DataFrame, shapes: DataFrame, groups: DataFrame, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """Annotations and metadata of labelled photos, a row each for every source row.

    ``sources`` has filename, title, source, license and artist; ``images`` filename, sha256, width and height; ``shapes`` filename, place,
    label, shape_type and points; ``groups`` filename, location_id and session_id. Evaluation fails if names of sources, images and groups aren't
    the same, once each, or if a shape is no valid polygon of one of ``labels``. An image without shapes has an empty annotation, which nobody
    has reviewed: it is never a certified negative.

    Annotations: sample_id, source_sha256, schema_version, objects, tactile (class_id, label, points; in order of place), n_shapes, review_status.
    Metadata: ``provenance`` and the group's ids, with the fixed values of published photos.
    """
    once = lambda d, flag: d.groupBy("filename").agg(F.count(F.lit(1)).alias(flag))
    counts = once(sources, "_s").join(once(images, "_i"), "filename", "full_outer").join(once(groups, "_g"), "filename", "full_outer")
    same = F.coalesce((F.col("_s") == 1) & (F.col("_i") == 1) & (F.col("_g") == 1), F.lit(False))
    names = require(counts, same, "source rows, images and groups don't match one to one").select("filename")
    sized = names.join(images, "filename")
    known = F.array(*(F.lit(x) for x in labels))
    class_id = F.array_position(known, F.col("label")).cast("int") - 1
    drawn = shapes.join(sized.select("filename", "width", "height"), "filename", "left")
    good = F.coalesce((F.col("shape_type") == "polygon") & (class_id >= 0) & F.col("width").isNotNull() & polygon_error("points", F.col("width"), F.col("height")).isNull(), F.lit(False))
    drawn = require(drawn, good, "a shape isn't a valid polygon of a known label and image")
    one = F.struct("place", class_id.alias("class_id"), "label", "points")
    tactile = drawn.groupBy("filename").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["class_id"].alias("class_id"), x["label"].alias("label"), x["points"].alias("points"))).alias("tactile"))
    kind = tactile.schema["tactile"].dataType
    made = sized.join(tactile, "filename", "left").withColumn("tactile", F.coalesce("tactile", F.array().cast(kind)))
    annotations = made.select(
        F.col("sha256").alias("sample_id"), F.col("sha256").alias("source_sha256"), F.lit(1).alias("schema_version"), F.array().cast("array<string>").alias("objects"),
        "tactile", F.size("tactile").alias("n_shapes"), F.when(F.size("tactile") > 0, "provisional").otherwise("unreviewed").alias("review_status"),
    )
    metadata = provenance(names.join(sources, "filename")).join(groups.withColumnRenamed("filename", "source_path"), "source_path").withColumns({c: F.lit(v) for c, v in PUBLISHED.items()})
    return annotations, metadata


def seeded_shapes(constants: DataFrame, images: DataFrame, label: str) -> DataFrame:
    """Provisional shapes from a table of normalised polygons (filename, place, points) and image sizes (filename, width,
    height): pixels of two decimals. An image that isn't there is an error."""
    sized = require(constants.join(images.select("filename", "width", "height"), "filename", "left"), F.col("width").isNotNull(), "an image of the table isn't there")
    return sized.select("filename", "place", F.concat(stem("filename"), F.lit(".json")).alias("target"), F.lit(label).alias("label"), F.lit("polygon").alias("shape_type"), denormalised("points", "width", "height").alias("points"))


def merged_sets(inputs: list[DataFrame], ready: list[Column | bool], key: str, split: str, protected: DataFrame, splits: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """The union of reviewed sets. Evaluation fails if an input isn't ready, if a key occurs twice in all, if one is
    protected, or if a split has no row; ``ready`` tells for each input whether its summary allows training."""
    marked = [d.withColumn("_ready", r if isinstance(r, Column) else F.lit(r)) for d, r in zip(inputs, ready, strict=True)]
    rows = reduce(DataFrame.unionByName, marked)
    rows = require(rows, F.col("_ready"), "an input isn't ready for training").drop("_ready")
    rows = require(rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key))), F.col("_n") == 1, "content stands in two inputs").drop("_n")
    held = protected.select(key, F.lit(True).alias("_protected")).distinct()
    rows = require(rows.join(held, key, "left"), F.col("_protected").isNull(), "protected content").drop("_protected")
    found = rows.groupBy(split).agg(F.count(F.lit(1)).alias("n")).agg(F.collect_set(split).alias("_splits"))
    wanted = F.array(*(F.lit(s) for s in splits))
    return require(rows.join(F.broadcast(found), how="inner"), F.size(F.array_except(wanted, "_splits")) == 0, "a split has no row").drop("_splits")


def first_decodable(frames: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """For each key the first value, by ``order``, that isn't null; keys without one are an error."""
    out = frames.groupBy(*key).agg(F.min(F.when(F.col(value).isNotNull(), F.struct(order, value))).alias("_f"))
    return require(out, F.col("_f").isNotNull(), "nothing can be decoded").select(*key, F.col(f"_f.{order}").alias(order), F.col(f"_f.{value}").alias(value))


def mixture_plan(main: DataFrame, extra: DataFrame, held: DataFrame, ratio: int, name: str, seed: int, share: float = 0.1) -> DataFrame:
    """Rows of a training mixture: split, source, ``name`` and target_name.

    ``main`` in seeded order gives its head to validation and the rest to training; ``extra`` joins training in its own
    seeded order, one place for each ``ratio`` training rows, from the start again once all are used; ``held`` joins
    validation.
    """
    from oriel.operators.select import holdout_head, ranked, ratio_mix, seeded_order

    public = holdout_head(ranked(seeded_order(main.select(name), name, seed), ["order_key", name]), share).select(name, "part")
    train = public.filter("part = 'train'")
    station = ratio_mix(train, ranked(seeded_order(extra.select(name), name, seed), ["order_key", name]), ratio, name)
    text = F.col(name).cast("string")
    return (
        public.select(F.when(F.col("part") == "train", "train").otherwise("val").alias("split"), F.lit("public").alias("source"), text.alias(name), F.concat(F.lit("public-"), text).alias("target_name"))
        .unionByName(station.select(F.lit("train").alias("split"), F.lit("station").alias("source"), text.alias(name), F.format_string("station-%04d-%s", "place", text).alias("target_name")))
        .unionByName(held.select(F.lit("val").alias("split"), F.lit("station").alias("source"), text.alias(name), F.concat(F.lit("station-"), text).alias("target_name")))
    )
