"""From a folder of code to stored, searchable indexes of one or two models."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanseek import fixed_values as fv
from spanseek.encoders import Encoder
from spanseek.functions import text as tx
from spanseek.models import Model, fingerprint
from spanseek.operators.alignment import require_valid
from spanseek.operators.units import decoded, outlines, split_units, with_unit_id
from spanseek.plans.search import searchable
from spanseek.schemas import INDEX_META, unit_key
from spanseek.session import skew_join, written
from spanseek.sources.code_tree import source_files
from spanseek.sources.repository import head_commit
from spanseek.sources.store import StoredIndex, VectorCache, missing_keys


def units_of(spark: SparkSession, *roots: str, max_chars: int = fv.MAX_CHARS, min_chars: int = fv.INDEX_MIN_CHARS) -> DataFrame:
    """Numbered units of the source files below ``roots``. Of several roots, ``root`` tells which one a unit is from; of one it is
    empty, so that an index does not depend on where its checkout lies."""
    files = decoded(source_files(spark, *roots))
    if len(roots) == 1:
        files = files.withColumn("root", F.lit(""))
    read = written(outlines(files, max_chars))
    return with_unit_id(split_units(read, max_chars, min_chars))


def embedded(units: DataFrame, encoder: Encoder, cache: VectorCache | None = None, batch_sort: bool = True) -> tuple[DataFrame, int, int]:
    """Units with ``vector``, the number of texts embedded now and of units served from the cache.

    Equal texts are embedded once. Texts of similar length are batched together. One text may be shared by a third of the
    units, so vectors come back through a join that spreads hot keys.
    """
    keyed = written(units.withColumn("_text", tx.embed_text(F.col("path"), F.col("kind"), F.col("qualname"), F.col("text")))
                    .withColumn("vector_key", tx.vector_key(encoder.model, "document", F.col("_text"))))
    todo = keyed.select("vector_key", "_text")
    if cache is not None:
        todo = missing_keys(todo, cache.read())
    else:
        todo = todo.dropDuplicates(["vector_key"])
    if batch_sort:
        todo = todo.sortWithinPartitions(F.length("_text"))
    fresh = written(todo.select("vector_key", encoder.embed(F.col("_text"), "document").alias("vector")))
    new = fresh.count()
    if cache is not None:
        cache.append(fresh)
    vectors = fresh if cache is None else cache.read()
    out = skew_join(keyed.drop("_text"), vectors, "vector_key", "unit_id")
    total = keyed.count()
    return out.drop("vector_key"), new, total - new


def build(spark: SparkSession, root: str, encoder: Encoder, *, cache: VectorCache | None = None, max_chars: int = fv.MAX_CHARS,
          min_chars: int = fv.INDEX_MIN_CHARS, units: DataFrame | None = None) -> StoredIndex:
    """Split (unless ``units`` is given, as when two models share one splitting) and embed one checkout."""
    began = time.perf_counter()
    units = units_of(spark, root, max_chars=max_chars, min_chars=min_chars) if units is None else units
    rows, new, cached = embedded(units, encoder, cache)
    rows = written(searchable(rows))
    dim = require_valid(rows)
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("root", "path").alias("files")).first()
    model: Model = encoder.model
    meta = spark.createDataFrame([(
        str(root).rstrip("/").rsplit("/", 1)[-1], str(root), head_commit(root), model.hf_id, model.revision,
        fingerprint(model, kind="document", precision="fp32"), max_chars, min_chars, counts["n"], counts["files"], dim, new, cached,
        round(time.perf_counter() - began, 1), time.strftime("%Y-%m-%d %H:%M:%S"))], INDEX_META)
    return StoredIndex(rows, meta)


def split_checkout(spark: SparkSession, root: str, **limits) -> DataFrame:
    """The units of one checkout, computed. RuntimeError when the folder holds no code."""
    units = written(units_of(spark, root, **limits))
    if units.isEmpty():
        raise RuntimeError("no Python, JavaScript or TypeScript code found")
    return units


def build_pair(spark: SparkSession, root: str, encoder_a: Encoder, encoder_b: Encoder, caches: tuple = (None, None),
               units: DataFrame | None = None, **limits) -> tuple[StoredIndex, StoredIndex]:
    """Both models over one splitting (``units``, where it was done before). RuntimeError when the folder holds no code."""
    units = split_checkout(spark, root, **limits) if units is None else units
    return tuple(build(spark, root, e, cache=c, units=units, **limits) for e, c in zip((encoder_a, encoder_b), caches))


def vectors_for(units_a: DataFrame, units_b: DataFrame) -> DataFrame:
    """The other index's vectors under this index's unit ids, matched on the unit key (the last of equal keys)."""
    key = unit_key(units_a)
    other = units_b.groupBy(*key).agg(F.max_by("vector", "unit_id").alias("vector"))
    return units_a.select("unit_id", *key).join(other, key).select("unit_id", "vector")
