"""Queries over sampling, tensors and training."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.functions import vectors as V
from millrace.operators import diffs, encoder, sampling, tensors, training
from millrace.sources import read_table

TEMPERATURE, TOP_P, PENALTY = 0.7, 0.95, 1.3


def _logits(spark: SparkSession, root: str) -> DataFrame:
    """Candidates per user: event ids with their value as logit."""
    return read_table(spark, root, "events").select(F.col("user_id").alias("group_id"), F.col("event_id").alias("idx"), (F.col("value") / 10).alias("value"))


def logit_topk(spark: SparkSession, root: str) -> DataFrame:
    return sampling.top_logits(_logits(spark, root), 8)


def logit_errors(spark: SparkSession, root: str) -> DataFrame:
    return sampling.check_logits(_logits(spark, root), 70)


def argmax_ties(spark: SparkSession, root: str) -> DataFrame:
    rows = _logits(spark, root).withColumn("value", F.floor("value").cast("double"))
    return sampling.greedy(rows)


def softmax_topp(spark: SparkSession, root: str) -> DataFrame:
    return sampling.softmax_top_p(_logits(spark, root), TEMPERATURE, TOP_P).select("group_id", "idx", F.round("p", 6).alias("p"), "rank")


def repetition_penalty(spark: SparkSession, root: str) -> DataFrame:
    """Clicks count as recent draws, one an occurrence."""
    recent = read_table(spark, root, "events").where(F.col("event_type") == "click").select(F.col("user_id").alias("group_id"), F.col("event_id").alias("idx"))
    rows = sampling.penalize_recent(_logits(spark, root).withColumn("value", F.col("value") - 2), recent.unionByName(recent), PENALTY)
    return rows.select("group_id", "idx", F.round("value", 6).alias("value"))


def repetition_window(spark: SparkSession, root: str) -> DataFrame:
    """Values of 50 candidates a user after the user's last 64 draws were pushed down, once for every draw."""
    events = read_table(spark, root, "events")
    drawn = events.select(F.col("user_id").alias("group_id"), F.col("event_id").alias("at"), (F.col("event_id") % 50).alias("idx"))
    rows = events.select(F.col("user_id").alias("group_id")).distinct().select("group_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(49).cast("bigint"))).alias("idx"))
    rows = rows.withColumn("value", F.col("idx") / 7.0 - 3.0)
    return sampling.penalize_recent(rows, sampling.recent_window(drawn), PENALTY).select("group_id", "idx", F.round("value", 6).alias("value"))


def _numbers(spark: SparkSession, root: str) -> DataFrame:
    return _logits(spark, root).select("group_id").distinct().withColumn("r", (F.col("group_id") % 97) / 97.0)


def categorical_draw(spark: SparkSession, root: str) -> DataFrame:
    return sampling.draw(sampling.softmax_top_p(_logits(spark, root), TEMPERATURE, TOP_P), _numbers(spark, root))


def sampled_tokens(spark: SparkSession, root: str) -> DataFrame:
    """The whole chain: purchases count as draws, the best eight stay, and one of them is drawn. Users without a finite value get the greatest."""
    events = read_table(spark, root, "events")
    rows = _logits(spark, root).withColumn("value", F.when(F.col("group_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    drawn = events.where(F.col("event_type") == "purchase").select(F.col("user_id").alias("group_id"), F.col("event_id").alias("at"), F.col("event_id").alias("idx"))
    return sampling.sample(rows, _numbers(spark, root), drawn, 0.8, 8, 0.9, PENALTY)


def softmax_errors(spark: SparkSession, root: str) -> DataFrame:
    """Vectors as logits: those that a softmax refuses, and why."""
    rows = read_table(spark, root, "index_vectors").where(F.size("embedding") > 0).select("vector_file", "chunk_id", "embedding").distinct()
    named = rows.select(F.concat_ws("#", "vector_file", "chunk_id").alias("group_id"), F.posexplode("embedding").alias("idx", "value")).where(F.col("value").isNotNull())
    return sampling.check_softmax(named, TEMPERATURE, TOP_P)


def _packed(spark: SparkSession, root: str) -> DataFrame:
    """Vectors packed to 4 bits, a scale and a bias for every eight components, a word for them."""
    base = F.col("embedding").cast("array<double>")
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda g: F.slice(base, g * 8 + 1, 8))
    rows = read_table(spark, root, "embeddings").select("vec_id", "label", base.alias("vec"), groups.alias("groups"))
    rows = rows.withColumn("biases", F.transform("groups", F.array_min)).withColumn("scales", F.transform("groups", lambda x: (F.array_max(x) - F.array_min(x)) / 15.0))
    level = lambda x, g: F.round((x - F.get("biases", g)) / F.get("scales", g)).cast("bigint")
    word = lambda part, g: F.aggregate(F.transform(part, lambda x, j: level(x, g) * F.pow(F.lit(16.0), j).cast("bigint")), F.lit(0).cast("bigint"), lambda s, v: s + v)
    return rows.withColumn("words", F.transform("groups", word))


def q4_dequant(spark: SparkSession, root: str) -> DataFrame:
    """Vectors packed and read back: how far they are off at most, and their sum."""
    rows = _packed(spark, root).select("vec_id", "vec", tensors.dequantize(F.col("words"), F.col("scales"), F.col("biases"), 8).alias("x"))
    error = F.array_max(F.zip_with("x", "vec", lambda a, b: F.abs(a - b)))
    return rows.select("vec_id", F.size("x").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 6).alias("total"), F.round(error, 6).alias("error"))


def q4_stats(spark: SparkSession, root: str) -> DataFrame:
    """Statistics of the stored vectors' components as if they were scales: null, infinite and undefined ones among them."""
    rows = read_table(spark, root, "index_vectors").where(F.col("embedding").isNotNull()).select("vector_file", "chunk_id", F.filter(F.col("embedding").cast("array<double>"), lambda x: x.isNotNull()).alias("scales")).distinct()
    return tensors.scale_stats(rows, "vector_file", "scales").select("vector_file", "nonfinite", "zero_scales", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def q4_layouts(spark: SparkSession, root: str) -> DataFrame:
    """Layouts that are refused: vectors files by their count of components and of vectors, one in eight of them too large to count."""
    rows = read_table(spark, root, "index_meta").withColumn("packed", F.when(F.col("count") % 8 == 0, F.lit(2**61)).otherwise(F.col("dim")))
    return rows.groupBy(tensors.layout_error(F.col("packed"), F.col("count"), 4, 32).alias("error")).agg(F.count("*").alias("n"))


def _patterns(spark: SparkSession) -> DataFrame:
    return spark.range(65536).select(F.col("id").cast("int").alias("bits"))


def bf16_check(spark: SparkSession, root: str) -> DataFrame:
    """All 65,536 bit patterns."""
    return _patterns(spark).groupBy(tensors.bf16_finite(F.col("bits")).alias("finite")).agg(F.count("*").alias("n"))


def bf16_values(spark: SparkSession, root: str) -> DataFrame:
    """The number of every bit pattern, infinite and undefined ones included, as text of 12 digits."""
    value = tensors.bf16_value(F.col("bits"))
    kind = F.when(F.isnan(value), "nan").when(F.abs(value) == float("inf"), F.when(value > 0, "inf").otherwise("-inf")).otherwise("number")
    plain = F.when(kind == "number", value)
    return _patterns(spark).select("bits", kind.alias("kind"), F.when(plain != 0, F.round(F.log(F.abs(plain)), 9)).alias("size"), (plain < 0).alias("negative"))


def frequencies(spark: SparkSession, root: str) -> DataFrame:
    """Rotary frequencies of 64 planes, interpolated for 16 times the original length."""
    rows = [(i, float(x)) for i, x in enumerate(tensors.yarn_frequencies(64, 1e6, 16.0, 16384))]
    return spark.createDataFrame(rows, "plane int, frequency double").select("plane", F.round("frequency", 12).alias("frequency"))


def weight_bytes(spark: SparkSession, root: str) -> DataFrame:
    """Bytes of the language part of a model whose tensors are the vector files, every other one of them."""
    rows = read_table(spark, root, "index_meta").select(
        F.concat(F.when(F.col("generation") % 2 == 0, "language_model.").otherwise("vision_tower."), F.col("vector_file")).alias("name"), F.lit(0).alias("start"), (F.col("dim") * F.col("count") * 4).alias("end")
    )
    return tensors.weight_bytes(rows, "language_model.")


def rotary(spark: SparkSession, root: str) -> DataFrame:
    """Vectors turned by their id as position; lengths stay."""
    rows = read_table(spark, root, "embeddings").select("vec_id", tensors.rotate(F.col("embedding").cast("array<double>"), F.col("vec_id").cast("double")).alias("x"))
    return rows.select("vec_id", F.round(F.element_at("x", 1), 6).alias("first"), F.round(F.element_at("x", -1), 6).alias("last"), F.round(V.norm(F.col("x")), 6).alias("norm"))


def attention_scales(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "orders").select("o_orderkey", F.round(tensors.attention_scale(F.col("o_orderkey"), 16384), 6).alias("scale"))


def layer_norms(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "embeddings").select("vec_id", tensors.layer_norm(F.col("embedding").cast("array<double>")).alias("x"))
    return rows.select("vec_id", F.round(F.element_at("x", 1), 6).alias("first"), F.round(F.element_at("x", 64), 6).alias("last"))


def matrix_product(spark: SparkSession, root: str) -> DataFrame:
    """Gram matrix of the components over all vectors."""
    return tensors.gram(read_table(spark, root, "embeddings"), "embedding").select("i", "j", F.round("v", 6).alias("v"))


def label_products(spark: SparkSession, root: str) -> DataFrame:
    """Product of two sparse matrices: how often labels bought each other's parts, by way of suppliers."""
    lines = read_table(spark, root, "lineitem")
    left = lines.groupBy(F.col("l_partkey").alias("k"), (F.col("l_linenumber")).cast("bigint").alias("i")).agg(F.sum("l_quantity").alias("v"))
    right = lines.groupBy(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("j")).agg(F.count("*").alias("v"))
    return tensors.multiply(left, right).select("i", "j", F.round("v", 4).alias("v"))


def attention_outputs(spark: SparkSession, root: str) -> DataFrame:
    """Softmax attention, one head, over sequences of a label's vectors, each from 640 neighbouring ids: the first two components of every place."""
    rows = read_table(spark, root, "embeddings")
    sequences = rows.groupBy(F.col("label").alias("id"), F.floor(F.col("vec_id") / 640).alias("part")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("x"))

    def run(batches):
        for batch in batches:
            ids, places, first, second = [], [], [], []
            for name, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.array([r["embedding"] for r in row], dtype=np.float64)[:, None, :]
                made = encoder.attention(x, x, x)[:, 0, :]
                ids += [name] * len(row)
                places += [r["vec_id"] for r in row]
                first += made[:, 0].tolist()
                second += made[:, 1].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(places, pa.int64()), pa.array(first, pa.float64()), pa.array(second, pa.float64())], ["id", "vec_id", "first", "second"])

    made = sequences.drop("part").mapInArrow(run, "id int, vec_id bigint, first double, second double")
    return made.select("id", "vec_id", F.round("first", 6).alias("first"), F.round("second", 6).alias("second"))


def mean_pooled(spark: SparkSession, root: str) -> DataFrame:
    """Mean vector of each label at unit length."""
    means = tensors.mean_vectors(read_table(spark, root, "embeddings"), "label", "embedding")
    size = F.sqrt(F.sum(F.col("mean") * F.col("mean")).over(Window.partitionBy("label")))
    return means.select("label", "axis", F.round(F.when(size > 0, F.col("mean") / size).otherwise(F.col("mean")), 6).alias("value"))


def contrastive_loss(spark: SparkSession, root: str) -> DataFrame:
    """Loss of each label's mean vector against the first vector of every label, and the second ones as hard negatives."""
    rows = read_table(spark, root, "embeddings")
    means = tensors.mean_vectors(rows, "label", "embedding").select(F.col("label").alias("i"), F.col("axis").alias("k"), F.col("mean").alias("v"))
    place = Window.partitionBy("label").orderBy("vec_id")
    two = rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= 2)
    actions = two.select((F.col("label") + (F.col("place") - 1) * 1000).alias("j"), F.posexplode("embedding").alias("k", "v"))
    pairs = tensors.multiply(means, actions.withColumn("v", F.col("v").cast("double"))).withColumnRenamed("v", "sim")
    return training.contrastive_loss(pairs, 0.1).select(F.round("loss", 6).alias("loss"))


def diff_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """A line put after the first one of every source file that has a text, applied, reverted and compared with the text."""
    files = read_table(spark, root, "source_files").where(F.col("text").isNotNull())
    files = files.select(F.concat_ws("/", F.col("file_id").cast("string"), "path").alias("path"), "text").distinct()
    first = F.substring_index("text", "\n", 1)
    open_ = F.when(F.col("text").contains("\n"), "").otherwise(f"\n{diffs.NO_NEWLINE}")
    hunk = F.when(F.col("text") == "", "@@ -0,0 +1,1 @@").otherwise(F.concat(F.lit("@@ -1,1 +1,2 @@\n-"), first, open_, F.lit("\n+"), first))
    patch = F.concat(F.lit("--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n"), hunk, F.lit("\n+# checked\n"))
    patches = files.select(F.col("path").alias("patch_id"), patch.alias("diff"))
    pins = files.select(F.col("path").alias("patch_id"), "path", F.sha2("text", 256).alias("sha256"))
    done = diffs.apply_patches(patches, files, pins)
    back = diffs.revert(done, done.select("path", F.col("new_text").alias("text"))).withColumnRenamed("text", "back")
    same = back.join(files, "path").select("patch_id", "path", F.col("back").eqNullSafe(F.col("text")).alias("same"))
    return done.join(same, ["patch_id", "path"], "left").select(
        "patch_id", "added", "removed", "error", (F.length("new_text") - F.length("old_text")).alias("grown"), F.coalesce("same", F.lit(False)).alias("restored")
    )


def edited_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file's first line replaced where it occurs once, by a diff that is made, applied and told by its result."""
    files = read_table(spark, root, "source_files").where(F.col("text").isNotNull() & (F.col("text") != ""))
    files = files.select(F.concat_ws("/", F.col("file_id").cast("string"), "path").alias("path"), "text").distinct()
    edits = files.select(F.col("path").alias("edit_id"), "path", F.substring_index("text", "\n", 1).alias("find"), F.lit("# first line").alias("put"))
    made = diffs.replacements(edits, files)
    patches = made.where(F.col("error").isNull()).select(F.col("edit_id").alias("patch_id"), "diff")
    pins = files.select(F.col("path").alias("patch_id"), "path", F.sha2("text", 256).alias("sha256"))
    done = diffs.apply_patches(patches, files, pins).select(F.col("patch_id").alias("edit_id"), F.md5("new_text").alias("digest"), F.col("error").alias("failed"))
    return made.select("edit_id", "error").join(done, "edit_id", "left").select("edit_id", F.coalesce("error", "failed").alias("error"), "digest")


def ranked_prices(spark: SparkSession, root: str) -> DataFrame:
    """Best three orders of each customer: the partitioned top-k of the engine on a star schema."""
    best = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    rows = read_table(spark, root, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= 3)


_LOGITS = "logits AS (SELECT user_id AS group_id, event_id AS idx, value / 10 AS value FROM events)"
_SOFTMAX = f"""{_LOGITS}, e AS (SELECT *, exp((value - max(value) OVER (PARTITION BY group_id)) / {TEMPERATURE}) AS e FROM logits),
c AS (SELECT *, e / sum(e) OVER (PARTITION BY group_id) AS chance FROM e),
o AS (SELECT *, row_number() OVER w AS rank, coalesce(sum(round(chance, 12)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c WINDOW w AS (PARTITION BY group_id ORDER BY round(chance, 12) DESC, idx)),
k AS (SELECT * FROM o WHERE rank = 1 OR round(before, 9) < {TOP_P}),
p AS (SELECT group_id, idx, chance / sum(chance) OVER (PARTITION BY group_id) AS p, rank FROM k)"""
_PACKED = """g AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS vec, list_transform(range(0, 8), lambda g: list_transform(embedding[g * 8 + 1:g * 8 + 8], lambda x: x::DOUBLE)) AS groups FROM embeddings),
b AS (SELECT *, list_transform(groups, lambda x: list_min(x)) AS biases, list_transform(groups, lambda x: (list_max(x) - list_min(x)) / 15.0::DOUBLE) AS scales FROM g),
values_ AS (SELECT vec_id, vec, list_transform(range(0, 64), lambda i: scales[i // 8 + 1] * round((vec[i + 1] - biases[i // 8 + 1]) / scales[i // 8 + 1]) + biases[i // 8 + 1]) AS x FROM b)"""

ORACLE = {
    "logit_topk": f"WITH {_LOGITS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY value DESC, idx) AS rank FROM logits) WHERE rank <= 8",
    "logit_errors": f"WITH {_LOGITS} SELECT group_id, 'k_too_large' AS error FROM logits GROUP BY group_id HAVING count(*) < 70",
    "argmax_ties": f"WITH {_LOGITS} SELECT group_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY floor(value) DESC, idx) AS k FROM logits) WHERE k = 1",
    "softmax_topp": f"WITH {_SOFTMAX} SELECT group_id, idx, round(p, 6) AS p, rank FROM p",
    "repetition_penalty": f"""WITH {_LOGITS}, r AS (SELECT user_id AS group_id, event_id AS idx, 2 * count(*) AS times FROM events WHERE event_type = 'click' GROUP BY 1, 2)
      SELECT group_id, idx, round(CASE WHEN value - 2 > 0 THEN (value - 2) / pow({PENALTY}, coalesce(times, 0)) ELSE (value - 2) * pow({PENALTY}, coalesce(times, 0)) END, 6) AS value FROM logits LEFT JOIN r USING (group_id, idx)""",
    "categorical_draw": f"""WITH {_SOFTMAX}, s AS (SELECT *, sum(p) OVER (PARTITION BY group_id ORDER BY rank) AS sum, (group_id % 97) / 97.0::DOUBLE AS r FROM p)
      SELECT group_id, coalesce(min_by(CASE WHEN round(sum, 9) >= r THEN idx END, CASE WHEN round(sum, 9) >= r THEN rank END), max_by(idx, rank)) AS idx FROM s GROUP BY group_id""",
    "repetition_window": f"""WITH d AS (SELECT user_id AS group_id, event_id % 50 AS idx, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events),
      r AS (SELECT group_id, idx, count(*) AS times FROM d WHERE back <= 64 GROUP BY 1, 2),
      l AS (SELECT group_id, idx, idx / 7.0::DOUBLE - 3.0 AS value FROM (SELECT DISTINCT user_id AS group_id FROM events), (SELECT unnest(range(0, 50)) AS idx))
      SELECT group_id, idx, round(CASE WHEN value > 0 THEN value / pow({PENALTY}, coalesce(times, 0)) ELSE value * pow({PENALTY}, coalesce(times, 0)) END, 6) AS value FROM l LEFT JOIN r USING (group_id, idx)""",
    "sampled_tokens": f"""WITH l AS (SELECT user_id AS group_id, event_id AS idx, value / 10 AS value FROM events WHERE user_id % 11 <> 0),
      d AS (SELECT user_id AS group_id, event_id AS idx, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events WHERE event_type = 'purchase'),
      r AS (SELECT group_id, idx, count(*) AS times FROM d WHERE back <= 64 GROUP BY 1, 2),
      q AS (SELECT group_id, idx, CASE WHEN value > 0 THEN value / pow({PENALTY}, coalesce(times, 0)) ELSE value * pow({PENALTY}, coalesce(times, 0)) END AS value FROM l LEFT JOIN r USING (group_id, idx)),
      k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY value DESC, idx) AS place FROM q) WHERE place <= 8),
      e AS (SELECT *, exp((value - max(value) OVER (PARTITION BY group_id)) / 0.8) AS e FROM k), c AS (SELECT *, e / sum(e) OVER (PARTITION BY group_id) AS chance FROM e),
      o AS (SELECT *, row_number() OVER w AS rank, coalesce(sum(round(chance, 12)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c WINDOW w AS (PARTITION BY group_id ORDER BY round(chance, 12) DESC, idx)),
      p AS (SELECT group_id, idx, chance / sum(chance) OVER (PARTITION BY group_id) AS p, rank FROM o WHERE rank = 1 OR round(before, 9) < 0.9),
      s AS (SELECT *, sum(p) OVER (PARTITION BY group_id ORDER BY rank) AS sum, (group_id % 97) / 97.0::DOUBLE AS r FROM p)
      SELECT group_id, coalesce(min_by(CASE WHEN round(sum, 9) >= r THEN idx END, CASE WHEN round(sum, 9) >= r THEN rank END), max_by(idx, rank)) AS idx FROM s GROUP BY group_id
      UNION ALL SELECT user_id, max(event_id) FROM events WHERE user_id % 11 = 0 GROUP BY 1""",
    "softmax_errors": """WITH v AS (SELECT DISTINCT vector_file, chunk_id, embedding FROM index_vectors WHERE len(embedding) > 0),
      x AS (SELECT concat_ws('#', vector_file, chunk_id) AS group_id, unnest(embedding) AS value FROM v),
      g AS (SELECT group_id, bool_or(isnan(value)) AS bad, max(CASE WHEN NOT isnan(value) THEN value END) AS top FROM x WHERE value IS NOT NULL GROUP BY 1)
      SELECT group_id, CASE WHEN bad THEN 'nan' ELSE 'degenerate' END AS error FROM g WHERE bad OR isinf(top)""",
    "q4_dequant": f"WITH {_PACKED} SELECT vec_id, len(x) AS n, round(list_sum(x), 6) AS total, round(list_max(list_transform(range(1, 65), lambda i: abs(x[i] - vec[i]))), 6) AS error FROM values_",
    "q4_stats": """WITH v AS (SELECT DISTINCT vector_file, chunk_id, list_filter(embedding, lambda x: x IS NOT NULL) AS e FROM index_vectors WHERE embedding IS NOT NULL),
      s AS (SELECT vector_file, unnest(e)::DOUBLE AS s FROM v)
      SELECT vector_file, sum(CASE WHEN isnan(s) OR isinf(s) THEN 1 ELSE 0 END)::BIGINT AS nonfinite, sum(CASE WHEN s = 0 THEN 1 ELSE 0 END)::BIGINT AS zero_scales,
        round(coalesce(min(CASE WHEN NOT isnan(s) AND NOT isinf(s) THEN s END), 0), 6) AS low, round(coalesce(max(CASE WHEN NOT isnan(s) AND NOT isinf(s) THEN s END), 0), 6) AS high FROM s GROUP BY 1""",
    "q4_layouts": """WITH m AS (SELECT CASE WHEN "count" % 8 = 0 THEN 2305843009213693952::HUGEINT ELSE dim END AS packed, "count" AS groups FROM index_meta)
      SELECT CASE WHEN packed * 8 > 9223372036854775807 THEN 'overflow' WHEN packed * 8 <> groups * 32 THEN 'columns' END AS error, count(*) AS n FROM m GROUP BY 1""",
    "bf16_check": "SELECT (bits & 32640) <> 32640 AS finite, count(*) AS n FROM (SELECT unnest(range(0, 65536)) AS bits) GROUP BY 1",
    "bf16_values": """WITH b AS (SELECT bits, (bits // 128) % 256 AS e, bits % 128 AS m, bits >= 32768 AS negative FROM (SELECT unnest(range(0, 65536))::INT AS bits)),
      v AS (SELECT bits, e, m, negative, CASE WHEN e < 255 THEN pow(2.0::DOUBLE, greatest(e, 1) - 127) * (m / 128.0::DOUBLE + CASE WHEN e > 0 THEN 1 ELSE 0 END) END AS size FROM b)
      SELECT bits, CASE WHEN e < 255 THEN 'number' WHEN m > 0 THEN 'nan' WHEN negative THEN '-inf' ELSE 'inf' END AS kind, CASE WHEN size > 0 THEN round(ln(size), 9) END AS size, CASE WHEN e < 255 THEN negative AND size > 0 END AS negative FROM v""",
    "frequencies": """WITH b AS (SELECT greatest(floor(128 * ln(16384 / (32 * 2 * pi())) / (2 * ln(1e6))), 0) AS low, least(ceil(128 * ln(16384 / (1 * 2 * pi())) / (2 * ln(1e6))), 127) AS high),
      p AS (SELECT i AS plane, pow(1e6, -(i / 64.0::DOUBLE)) AS plain, least(greatest((i - low) / greatest(high - low, 1e-3), 0), 1) AS ramp FROM (SELECT unnest(range(0, 64))::INT AS i), b)
      SELECT plane, round(plain * (1 - ramp) + plain / 16 * ramp, 12) AS frequency FROM p""",
    "weight_bytes": """SELECT coalesce(sum(dim * "count" * 4), 0)::BIGINT AS bytes, count(*) AS tensors FROM index_meta WHERE generation % 2 = 0""",
    "rotary": """WITH x AS (SELECT vec_id, list_transform(range(0, len(embedding)), lambda i: CASE WHEN i < len(embedding) // 2
        THEN embedding[i + 1]::DOUBLE * cos(vec_id * pow(10000.0, -(i::DOUBLE) / (len(embedding) // 2))) - embedding[i + 1 + len(embedding) // 2]::DOUBLE * sin(vec_id * pow(10000.0, -(i::DOUBLE) / (len(embedding) // 2)))
        ELSE embedding[i + 1 - len(embedding) // 2]::DOUBLE * sin(vec_id * pow(10000.0, -((i - len(embedding) // 2)::DOUBLE) / (len(embedding) // 2))) + embedding[i + 1]::DOUBLE * cos(vec_id * pow(10000.0, -((i - len(embedding) // 2)::DOUBLE) / (len(embedding) // 2))) END) AS x FROM embeddings)
      SELECT vec_id, round(x[1], 6) AS first, round(x[-1], 6) AS last, round(sqrt(list_sum(list_transform(x, lambda v: v * v))), 6) AS norm FROM x""",
    "attention_scales": "SELECT o_orderkey, round(1 + 0.1::DOUBLE * ln(1 + floor(o_orderkey / 16384)), 6) AS scale FROM orders",
    "layer_norms": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings), m AS (SELECT *, list_sum(v) / len(v) AS mean FROM e),
      s AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: (x - mean) * (x - mean))) / len(v) + 1e-12) AS spread FROM m)
      SELECT vec_id, round((v[1] - mean) / spread, 6) AS first, round((v[64] - mean) / spread, 6) AS last FROM s""",
    "matrix_product": """WITH r AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS i FROM embeddings))
      SELECT a.i, b.i AS j, round(sum(a.v * b.v), 6) AS v FROM r a JOIN r b USING (vec_id) GROUP BY a.i, b.i""",
    "label_products": """WITH a AS (SELECT l_partkey AS k, l_linenumber AS i, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), b AS (SELECT l_partkey AS k, l_suppkey AS j, count(*) AS v FROM lineitem GROUP BY 1, 2)
      SELECT i, j, round(sum(a.v * b.v), 4) AS v FROM a JOIN b USING (k) GROUP BY 1, 2""",
    "attention_outputs": """WITH e AS (SELECT label AS id, vec_id, vec_id // 640 AS part, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
      z AS (SELECT a.id, a.vec_id, b.v[1] AS v1, b.v[2] AS v2, list_dot_product(a.v, b.v) / 8.0 AS z FROM e a JOIN e b USING (id, part)),
      w AS (SELECT *, exp(z - max(z) OVER (PARTITION BY id, vec_id)) AS w FROM z)
      SELECT id, vec_id, round(sum(w * v1) / sum(w), 6) AS first, round(sum(w * v2) / sum(w), 6) AS second FROM w GROUP BY 1, 2""",
    "mean_pooled": """WITH x AS (SELECT label, (i - 1)::INT AS axis, avg(embedding[i]::DOUBLE) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i)
      SELECT label, axis, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS value FROM x""",
    "contrastive_loss": """WITH m AS (SELECT label, list(m ORDER BY i) AS a FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
      f AS (SELECT label + (k - 1) * 1000 AS j, embedding AS b FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings) WHERE k <= 2),
      z AS (SELECT m.label AS i, j, list_dot_product(a, b::DOUBLE[]) / 0.1 AS z FROM m, f),
      l AS (SELECT *, ln(sum(exp(z)) OVER (PARTITION BY i)) - z + ln(sum(exp(z)) OVER (PARTITION BY j)) - z AS two FROM z)
      SELECT round(avg(two / 2), 6) AS loss FROM l WHERE i = j""",
    "diff_round_trip": """WITH f AS (SELECT DISTINCT concat_ws('/', file_id::VARCHAR, path) AS path, text FROM source_files WHERE text IS NOT NULL)
      SELECT path AS patch_id, CASE WHEN text = '' THEN 1 ELSE 2 END AS added, CASE WHEN text = '' THEN 0 ELSE 1 END AS removed, NULL::VARCHAR AS error,
        CASE WHEN text <> '' AND NOT contains(text, chr(10)) THEN 11 ELSE 10 END AS grown, true AS restored FROM f""",
    "edited_files": """WITH f AS (SELECT DISTINCT concat_ws('/', file_id::VARCHAR, path) AS path, text, string_split(text, chr(10))[1] AS find FROM source_files WHERE text IS NOT NULL AND text <> ''),
      n AS (SELECT *, CASE WHEN find = '' THEN 0 ELSE (length(text) - length(replace(text, find, ''))) // length(find) END AS times FROM f)
      SELECT path AS edit_id, CASE WHEN times <> 1 THEN 'ambiguous' END AS error, CASE WHEN times = 1 THEN md5(replace(text, find, '# first line')) END AS digest FROM n""",
    "ranked_prices": "SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3",
}

QUERIES = (
    logit_topk, logit_errors, argmax_ties, softmax_topp, softmax_errors, repetition_penalty, repetition_window, categorical_draw, sampled_tokens, q4_dequant, q4_stats, q4_layouts, bf16_check, bf16_values,
    frequencies, weight_bytes, rotary, attention_scales, layer_norms, matrix_product, label_products, attention_outputs, mean_pooled, contrastive_loss, diff_round_trip, edited_files, ranked_prices,
)
