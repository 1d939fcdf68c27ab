"""Building manifests from file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.operators.columns import with_struct
from evalloom.operators.sampling import balanced_sample, hash_text

# --- fixed values: name pattern, task, parser and parameters of each image set ---
PATH_RULES = [
    {
        "pattern": r"pixels_(\d+)_rotation_(\w+)_diameter_([\d.]+)_distance_(-?[\d.]+)\.png",
        "task": "touching_circle", "parser": "yes_no",
        "params": [("resolution", "bigint"), ("rotation", "string"), ("diameter", "double"),
                   ("distance", "double")],
        "prompt": "Are the two circles touching each other? Answer with Yes/No.",
    },
    {
        "pattern": r"nested_squares_depth_(\d+)_image_(\d+)_thickness_(\d+)",
        "task": "nested_squares", "parser": "integer",
        "params": [("depth", "bigint"), ("image_id", "bigint"), ("thickness", "bigint")],
        "prompt": "Count total number of squares in the image. "
                  "Answer with only the number in numerical format in curly brackets e.g. {3}.",
    },
    {
        "pattern": r"grid_(\d+)x(\d+)_(\d+)_(\d+)",
        "task": "counting_grid_paths", "parser": "row_col",
        "params": [("rows", "bigint"), ("cols", "bigint"), ("resolution", "bigint"),
                   ("line_width", "bigint")],
        "prompt": "Count the number of rows and columns and answer with numbers in curly brackets. "
                  "For example, rows={5} columns={6}",
    },
    {
        "pattern": r"numCircles_(\d+)",
        "task": "counting_circles", "parser": "integer",
        "params": [("num_circles", "bigint")],
        "prompt": "Count the circles in the image. "
                  "Answer with a number in curly brackets e.g. {3}.",
    },
]
PREFERRED_DIRECTORIES = ["sonnet-3.5", "Sonnet-3.5", "sonnet3.5"]
# ---------------------------------------------------------------------------------


def list_paths(spark: SparkSession, root: str) -> DataFrame:
    """Paths below a folder; the content column is pruned away."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select("path")
    )


def _truth(rule: dict, groups: list[Column]) -> Column:
    if rule["task"] == "touching_circle":
        return F.when(groups[3].try_cast("double") == 0.0, "Yes").otherwise("No")
    if rule["parser"] == "row_col":
        return F.concat(groups[0], F.lit(","), groups[1])
    return groups[0]


def label_paths(paths: DataFrame, source: str = "paths") -> DataFrame:
    """Manifest rows from paths, marked with where they come from; names that fit no pattern are dropped.

    One pass: each path is tested against the patterns in order.
    """
    name = F.substring_index("path", "/", -1)
    row: Column | None = None
    for rule in PATH_RULES:
        groups = [F.regexp_extract(name, rule["pattern"], i + 1) for i in range(len(rule["params"]))]
        params = F.to_json(
            F.struct(
                *[g.try_cast(kind).alias(p) for g, (p, kind) in zip(groups, rule["params"])]
            )
        )
        made = F.struct(
            F.lit(rule["task"]).alias("task_name"), F.lit(rule["prompt"]).alias("prompt"),
            _truth(rule, groups).alias("ground_truth"), F.lit(rule["parser"]).alias("parser"),
            params.alias("params"),
        )
        fits = F.rlike(name, F.lit(rule["pattern"]))
        row = F.when(fits, made) if row is None else row.when(fits, made)
    names = ["task_name", "prompt", "ground_truth", "parser", "params"]
    labelled = with_struct(paths, row, names).where(F.col("task_name").isNotNull())
    return labelled.select(
        F.substring(hash_text("path", F.col("path")), 1, 8).alias("sample_id"),
        "task_name", F.col("path").alias("image_path"), "prompt", "ground_truth",
        "parser", F.lit("exact_match").alias("scorer"), "params", F.lit(source).alias("source"),
    )


def sample_paths(paths: DataFrame, max_per_class: int = 20, seed: int = 42, source: str = "paths") -> DataFrame:
    """Labelled paths, at most ``max_per_class`` per task and truth."""
    return balanced_sample(
        label_paths(paths, source), ["task_name", "ground_truth"], max_per_class, seed, "image_path"
    ).drop("rank")


def preferred_directories(paths: DataFrame) -> DataFrame:
    """Keep each image set's paths of one directory: a preferred one, else the first by name.

    Paths end in ``<set>/<directory>/<correct|incorrect>/<file>``. The choice is an
    aggregate per set, so no set is sorted as a whole.
    """
    parts = F.split("path", "/")
    split = paths.select(
        "path", F.try_element_at(parts, F.lit(-4)).alias("image_set"),
        F.try_element_at(parts, F.lit(-3)).alias("directory"),
        F.try_element_at(parts, F.lit(-2)).alias("verdict"),
    ).where(F.col("verdict").isin("correct", "incorrect"))
    rank = F.lit(len(PREFERRED_DIRECTORIES))
    for i, directory in reversed(list(enumerate(PREFERRED_DIRECTORIES))):
        rank = F.when(F.col("directory") == directory, i).otherwise(rank)
    chosen = split.groupBy("image_set").agg(
        F.min(F.struct(rank.alias("rank"), "directory"))["directory"].alias("directory")
    )
    return split.join(chosen, ["image_set", "directory"], "left_semi")
