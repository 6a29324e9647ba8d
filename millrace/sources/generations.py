"""Generations of vectors in a shared folder: one folder a generation, and a pointer that names the current one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


def _place(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()), made


def write_generation(vectors: DataFrame, folder: str, generation: int) -> str:
    """Write ``vectors`` under ``folder/generation=N`` and point at it; readers see the old generation or the new one.

    The pointer is a small file, written beside and renamed; ``folder`` may be on
    any file system that Spark knows.
    """
    spark, target = vectors.sparkSession, f"{folder}/generation={generation}"
    vectors.write.mode("overwrite").parquet(target)
    system, fresh = _place(spark, f"{folder}/{POINTER}.tmp")
    out = system.create(fresh, True)
    out.write(bytearray(str(generation).encode()))
    out.close()
    _, pointer = _place(spark, f"{folder}/{POINTER}")
    if system.exists(pointer):
        system.delete(pointer, False)
    if not system.rename(fresh, pointer):
        raise OSError(f"the pointer of {folder} could not be moved")
    return target


def current_generation(spark: SparkSession, folder: str) -> int | None:
    """The generation that the pointer names, or else the last one that is there."""
    system, pointer = _place(spark, f"{folder}/{POINTER}")
    if system.exists(pointer):
        return int(spark.read.text(f"{folder}/{POINTER}").first()[0])
    _, base = _place(spark, folder)
    if not system.exists(base):
        return None
    names = [x.getPath().getName() for x in system.listStatus(base)]
    return max((int(n.split("=")[1]) for n in names if n.startswith("generation=")), default=None)


def read_generation(spark: SparkSession, folder: str, generation: int | None = None) -> DataFrame:
    wanted = current_generation(spark, folder) if generation is None else generation
    if wanted is None:
        raise FileNotFoundError(f"{folder} has no generation")
    return spark.read.parquet(f"{folder}/generation={wanted}")


def drop_generations(spark: SparkSession, folder: str, keep: set[int]) -> list[int]:
    """Delete the generations that are not in ``keep`` nor current; their numbers."""
    system, base = _place(spark, folder)
    kept, gone = keep | {current_generation(spark, folder)}, []
    for entry in system.listStatus(base):
        name = entry.getPath().getName()
        if name.startswith("generation=") and int(name.split("=")[1]) not in kept:
            system.delete(entry.getPath(), True)
            gone.append(int(name.split("=")[1]))
    return sorted(gone)
