"""Explicit schemas of all tables that are read; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names of the manifests, in order.
INTAKE_COLUMNS = "source_path session_id location_id location_type source_name usage_permission device_model camera_position lighting motion surface dataset_task notes".split()
REVIEW_COLUMNS = "sample_id source_sha256 annotation_sha256 review_status reviewer reviewed_at notes".split()
TRUTH_COLUMNS = (
    "sample_id source_path source_sha256 dataset_role prediction_tactile_present prediction_mask_coverage ground_truth_tactile_present ground_truth_mask_path ground_truth_mask_sha256 annotation_origin annotation_id review_status reviewer reviewed_at notes".split()
)
#: Columns that older ground-truth manifests have.
TRUTH_LEGACY = "sample_id source_path dataset_role prediction_tactile_present prediction_mask_coverage ground_truth_tactile_present ground_truth_mask_path review_status notes".split()
#: Columns of a source table in CSV form.
SOURCE_COLUMNS = "filename title source_url license artist".split()

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
ANNOTATION = T.StructType(
    [
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("sample_id", T.StringType()),
        T.StructField("source_sha256", T.StringType()),
        T.StructField("objects", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("bbox", T.ArrayType(T.DoubleType()))]))),
        T.StructField("tactile", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("points", T.ArrayType(T.ArrayType(T.DoubleType())))]))),
    ]
)
SHAPES = T.StructType(
    [
        T.StructField("imagePath", T.StringType()),
        T.StructField("imageWidth", T.IntegerType()),
        T.StructField("imageHeight", T.IntegerType()),
        T.StructField("shapes", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("shape_type", T.StringType()), T.StructField("points", T.ArrayType(T.ArrayType(T.DoubleType())))]))),
    ]
)
SAMPLE = T.StructType([T.StructField(n, T.StringType()) for n in ("sample_id", "source_path", "source_sha256", "location_id", "session_id", "split", "split_group", "dataset_task", "location_type")])
MANIFEST = T.StructType(
    [
        T.StructField("manifest_version", T.IntegerType()),
        T.StructField("dataset_version", T.StringType()),
        T.StructField("split_seed", T.IntegerType()),
        T.StructField("samples", T.ArrayType(SAMPLE)),
    ]
)
SCOPE = T.StructType([T.StructField("dataset_scope", T.StringType()), T.StructField("images", T.MapType(T.StringType(), T.StringType()))])
TAXONOMY = T.StructType(
    [T.StructField("taxonomy_version", T.StringType()), T.StructField("approval_status", T.StringType()), T.StructField("object_labels", T.ArrayType(T.StringType())), T.StructField("tactile_labels", T.ArrayType(T.StringType()))]
)
MODEL = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("size_bytes", T.LongType()), T.StructField("sha256", T.StringType()), T.StructField("labels", T.MapType(T.StringType(), T.StringType()))]
)
MODELS = T.StructType([T.StructField("models", T.MapType(T.StringType(), MODEL))])


SOURCE = T.StructType([T.StructField("set_index", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("filename", "title", "source", "license", "artist"))])
INVENTORY_FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("url", T.StringType())])
INVENTORY_PAGE = T.StructType([*(T.StructField(n, T.StringType()) for n in ("page_token", "next_page_token", "error_message")), T.StructField("files", T.ArrayType(INVENTORY_FILE))])


def strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])
