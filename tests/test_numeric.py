"""Sampling, tensors and training against pinned values and numpy."""

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import encoder, sampling, tensors, training


def logits(spark, values, group=0):
    return spark.createDataFrame([(group, i, float(v)) for i, v in enumerate(values)], "group_id long, idx long, value double")


def picks(rows):
    return [r.idx for r in rows.orderBy("rank").collect()]


def test_top_logits(spark):
    inf = float("inf")
    assert picks(sampling.top_logits(logits(spark, [1, inf, 3, -inf, 3]), 5)) == [1, 2, 4, 0, 3]
    assert picks(sampling.top_logits(logits(spark, [i % 5 for i in range(50)]), 3)) == [4, 9, 14]
    errors = lambda v, k: [r.error for r in sampling.check_logits(logits(spark, v), k).collect()]
    assert errors([1, 2], 0) == ["zero_k"] and errors([1], 2) == ["k_too_large"] and errors([float("nan"), 1], 1) == ["nan"] and errors([1], 1) == []


def test_softmax_top_p(spark):
    rows = sampling.softmax_top_p(logits(spark, [10, 0, 0, 0]), 1.0, 0.1).collect()
    assert [(r.idx, r.p) for r in rows] == [(0, 1.0)]
    assert {r.idx for r in sampling.softmax_top_p(logits(spark, [10, 9, 1, 0, -5]), 1.0, 0.5).collect()} == {0}
    full = {r.idx: r.p for r in sampling.softmax_top_p(logits(spark, [0, 1, 2]), 0.5, 1.0).collect()}
    want = np.exp(np.array([0, 2, 4.0]))
    assert np.allclose([full[i] for i in range(3)], want / want.sum())
    assert sum(full.values()) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        sampling.softmax_top_p(logits(spark, [1]), 0.0, 0.5)


def test_penalty_draw_greedy(spark):
    recent = spark.createDataFrame([(0, 0)], "group_id long, idx long")
    pushed = sampling.penalize_recent(logits(spark, [2, 1.9]), recent, 1.5)
    assert sampling.greedy(pushed).first().idx == 1
    nan = float("nan")
    assert sampling.greedy(logits(spark, [0.1, nan, 3, 2])).first().idx == 2 and sampling.greedy(logits(spark, [nan, 1])).first().idx == 1 and sampling.greedy(logits(spark, [nan, nan])).first().idx == 1
    chances = spark.createDataFrame([(0, 5, 0.5, 1), (0, 7, 0.5, 2)], "group_id long, idx long, p double, rank int")
    drawn = lambda r: sampling.draw(chances, spark.createDataFrame([(0, r)], "group_id long, r double")).first().idx
    assert drawn(0.5) == 5 and drawn(0.51) == 7 and drawn(1.5) == 7


def test_sample_chain_and_statistics(spark):
    numbers = sampling.uniform24(0x5EED, 600)
    assert all(0 <= x < 1 for x in numbers) and numbers == sampling.uniform24(0x5EED, 600)
    rows = spark.createDataFrame([(g, i, v) for g in range(600) for i, v in enumerate([math.log(2.0), 0.0])], "group_id long, idx long, value double")
    drawn = sampling.sample(rows, spark.createDataFrame(list(enumerate(numbers)), "group_id long, r double"), temperature=1.0)
    share = drawn.where("idx = 0").count() / 600
    assert abs(share - 2 / 3) < 0.06
    assert sampling.sample(logits(spark, [1, float("nan"), 2]), spark.createDataFrame([(0, 0.5)], "group_id long, r double")).first().idx == 2


def test_dequantize(spark):
    row = spark.createDataFrame([([0x76543210, 0xFEDCBA98], [2.0], [-1.0])], "w array<long>, s array<double>, b array<double>")
    got = row.select(tensors.dequantize(F.col("w"), F.col("s"), F.col("b"), 16).alias("x"), tensors.layout_error(F.size("w"), F.size("s"), 4, 16).alias("e")).first()
    assert got.x == [2.0 * q - 1 for q in range(16)] and got.e is None
    bad = lambda bits, group, words=2: row.select(tensors.layout_error(F.lit(words), F.size("s"), bits, group).alias("e")).first().e
    assert bad(8, 16) == "bits" and bad(4, 0) == "group_size" and bad(4, 8) == "columns" and bad(4, 16, 2**61) == "overflow"
    stats = tensors.scale_stats(spark.createDataFrame([(1, [0.0, 2.0, float("nan"), float("-inf")]), (2, [float("nan")])], "k int, s array<double>"), "k", "s")
    assert {tuple(r) for r in stats.collect()} == {(1, 2, 1, 0.0, 2.0), (2, 1, 0, 0.0, 0.0)}


def test_positions(spark):
    freqs = tensors.yarn_frequencies(64, 1e6, 16, 16384)
    plain = [1e6 ** (-i / 64) for i in range(64)]
    assert freqs[0] == 1.0 and freqs[63] == pytest.approx(plain[63] / 16)
    scale = lambda p: spark.range(1).select(tensors.attention_scale(F.lit(p), 16384).alias("x")).first().x
    assert scale(16383) == 1.0 and scale(16384) == pytest.approx(1 + 0.1 * math.log(2))
    turned = spark.range(1).select(tensors.rotate(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(2.0)), F.lit(3.0), 100.0).alias("x")).first().x
    assert turned == pytest.approx([math.cos(3), -2 * math.sin(0.3), math.sin(3), 2 * math.cos(0.3)])
    normed = spark.range(1).select(tensors.layer_norm(F.array(F.lit(1.0), F.lit(2.0), F.lit(6.0))).alias("x")).first().x
    want = np.array([1, 2, 6.0])
    assert normed == pytest.approx(list((want - want.mean()) / want.std()))


def safetensors(header, body=b""):
    raw = header if isinstance(header, bytes) else json.dumps(header).encode()
    return struct.pack("<Q", len(raw)) + raw + body


def test_tensor_catalog(spark):
    good = safetensors({"__metadata__": {}, "b": {"dtype": "F32", "shape": [2, 2], "data_offsets": [0, 16]}, "a": {"dtype": "BF16", "shape": [], "data_offsets": [16, 18]}}, b"\0" * 18)
    entry = {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}
    bad = {
        "dtype": entry | {"dtype": "F7"}, "shape": entry | {"shape": [-2]}, "offsets": entry | {"data_offsets": [4, 99]}, "size": entry | {"shape": [3]}, "entry": {"dtype": "F32"},
    }
    assert [x[:3] for x in tensors.parse_header(good, len(good))] == [("a", "BF16", []), ("b", "F32", [2, 2])]
    for error, e in bad.items():
        raw = safetensors({"x": e}, b"\0" * 8)
        assert tensors.parse_header(raw, len(raw))[0][5] == error
    for raw, error in [(b"abc", "short"), (struct.pack("<Q", 99) + b"{}", "header_length"), (safetensors(b"{"), "json"), (safetensors(b"[1]"), "json"), (safetensors(b"\xff"), "json")]:
        assert tensors.parse_header(raw, len(raw))[0][5] == error
    files = spark.createDataFrame([("b.st", bytearray(good)), ("a.st", bytearray(good)), ("c.st", bytearray(b"no"))], "path string, content binary")
    catalog = tensors.tensor_catalog(files)
    assert catalog.count() == 5 and {r.path for r in tensors.first_shard(catalog).collect()} == {"a.st"}


@pytest.mark.parametrize(("n", "m"), [(3, 3), (3, 5), (1, 4)])
def test_gradients(n, m):
    """Both gradients against differences of the loss, and the loss against the two cross entropies written out."""
    rng = np.random.default_rng(10 * n + m)
    states, actions, ws, wa = rng.normal(size=(n, 6)), rng.normal(size=(m, 6)), rng.normal(size=(6, 4)), rng.normal(size=(6, 4))
    loss, by_state, by_action = training.loss_and_gradients(ws, wa, states, actions, 0.3)
    z = (states @ ws) @ (actions @ wa).T / 0.3
    rows = [math.log(sum(math.exp(v) for v in z[i])) - z[i, i] for i in range(n)]
    cols = [math.log(sum(math.exp(v) for v in z[:, j])) - z[j, j] for j in range(n)]
    assert loss == pytest.approx((sum(rows) + sum(cols)) / (2 * n))
    for which, grad in enumerate((by_state, by_action)):
        for i in np.ndindex(6, 4):
            step = np.zeros((6, 4))
            step[i] = 1e-6
            up, down = (training.loss_and_gradients(ws + s * step * (which == 0), wa + s * step * (which == 1), states, actions, 0.3)[0] for s in (1, -1))
            assert grad[i] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-6)


def test_training_halves_loss(tmp_path, spark):
    rng = np.random.default_rng(3)
    actions = rng.normal(size=(9, 16))
    states = actions[:6] + 0.5 * rng.normal(size=(6, 16))
    actions, states = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (actions, states))
    head, losses = training.fit_head(states, actions, 8)
    assert losses[-1] < losses[0] / 2
    head.save(f"{tmp_path}/head.json")
    back = training.Head.load(f"{tmp_path}/head.json")
    assert (back.state == head.state).all() and (back.action == head.action).all() and back.temperature == head.temperature
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(states)] + [(99, [0.0] * 16), (100, [1.0])], "id long, vec array<double>")
    made = {r.id: np.array(r.vec) for r in training.project(rows, head.state).collect()}
    want = states @ head.state
    assert set(made) == {*range(6), 99} and not made[99].any() and np.allclose([made[i] for i in range(6)], want / np.linalg.norm(want, axis=1, keepdims=True))


def test_normal_numbers():
    numbers = training.normal_numbers(42, 4000)
    assert abs(numbers.mean()) < 0.06 and abs(numbers.std() - 1) < 0.04 and (numbers == training.normal_numbers(43, 4000)).all() and not (numbers == training.normal_numbers(44, 4000)).all()
    x = 43
    x ^= x << 13 & (1 << 64) - 1
    x ^= x >> 7
    x ^= x << 17 & (1 << 64) - 1
    first = (x >> 11) / 2.0**53
    x ^= x << 13 & (1 << 64) - 1
    x ^= x >> 7
    x ^= x << 17 & (1 << 64) - 1
    assert numbers[0] == pytest.approx(math.sqrt(-2 * math.log(first + 1e-7)) * math.cos(2 * math.pi * (x >> 11) / 2.0**53), rel=1e-4)


def test_last_of_equal_scores(spark):
    scores = spark.createDataFrame([(1, 0, 0.5), (1, 3, 0.5), (2, 1, 0.9), (2, 2, 0.1)], "query_id int, idx int, score double")
    truth = spark.createDataFrame([(1, 3), (2, 2)], "query_id int, idx int")
    assert training.routing_accuracy(scores, truth).first() == (0.5, 2)


def test_softmax_refusals(spark):
    inf, nan = float("inf"), float("nan")
    rows = spark.createDataFrame([(1, 0, nan), (1, 1, 2.0), (2, 0, inf), (3, 0, -inf), (3, 1, -inf), (4, 0, 1.0), (4, 1, -inf)], "group_id int, idx int, value double")
    assert {(r.group_id, r.error) for r in sampling.check_softmax(rows, 1.0, 1.0).collect()} == {(1, "nan"), (2, "degenerate"), (3, "degenerate")}
    assert {r.error for r in sampling.check_softmax(rows, 0.0, 2.0).collect()} == {"temperature"} and {r.error for r in sampling.check_softmax(rows, 1.0, 0.0).collect()} == {"top_p"}
    assert [(r.group_id, r.idx, r.p) for r in sampling.softmax_top_p(rows, 1.0, 1.0).collect()] == [(4, 0, 1.0)]


def test_recent_window(spark):
    drawn = spark.createDataFrame([(1, t, t % 3) for t in range(10)] + [(2, 0, 5)], "group_id int, at int, idx int")
    assert sorted((r.group_id, r.idx) for r in sampling.recent_window(drawn, 4).collect()) == [(1, 0), (1, 0), (1, 1), (1, 2), (2, 5)]


def test_tensor_values(spark):
    body = np.array([1.5, -2.0], "<f4").tobytes() + np.array([0x3FC0, 0xC000], "<u2").tobytes() + np.array([1, 0], "u1").tobytes()
    raw = safetensors({"a": {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}, "b": {"dtype": "BF16", "shape": [1, 2], "data_offsets": [8, 12]}, "c": {"dtype": "BOOL", "shape": [2], "data_offsets": [12, 14]}}, body)
    files = spark.createDataFrame([("m.st", bytearray(raw))], "path string, content binary")
    wanted = spark.createDataFrame([("a", "F32", [2]), ("b", None, None), ("c", "BOOL", None), ("a2", None, None), ("b", "F32", None), ("a", "F32", [1, 2])], "name string, dtype string, shape array<long>")
    got = sorted(((r.name, r.error, r.values) for r in tensors.read_tensors(files, wanted).collect()), key=str)
    assert got == sorted([("a", None, [1.5, -2.0]), ("a", "shape", None), ("a2", "missing", None), ("b", None, [1.5, -2.0]), ("b", "dtype", None), ("c", None, [1.0, 0.0])], key=str)
    assert tensors.weight_bytes(tensors.tensor_catalog(files), "b").first() == (4, 1)
    bits = spark.createDataFrame([(0x3FC0,), (0xC000,), (0x0001,), (0x7F80,), (0x8000,)], "b int").select(tensors.bf16_value(F.col("b")).alias("x")).collect()
    assert [r.x for r in bits] == [1.5, -2.0, 2.0**-133, float("inf"), 0.0]


def test_products(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(7, 90)), rng.normal(size=(90, 5))
    a[rng.random(a.shape) < 0.7] = 0
    long = lambda m, names: spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m) if v], f"{names[0]} long, {names[1]} long, v double")
    got = np.zeros((7, 5))
    for r in tensors.multiply(long(a, "ik"), long(b, "kj"), 4).collect():
        got[r.i, r.j] = r.v
    assert np.allclose(got, a @ b)
    rows = spark.createDataFrame([(x.tolist(),) for x in b] + [(None,)], "v array<double>").repartition(3)
    assert np.allclose([r.v for r in tensors.gram(rows, "v").orderBy("i", "j").collect()], (b.T @ b).ravel())


def test_sparse_product_has_only_pairs_that_meet(spark):
    n = 3000
    left = spark.range(n).select(F.col("id").alias("i"), F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit(2.0).alias("v"))
    right = spark.range(n).select(F.col("id").alias("k"), (F.col("id") + 1).alias("j"), F.lit(3.0).alias("v"))
    got = tensors.multiply(left, right).collect()
    assert sorted((r.i, r.j, r.v) for r in got) == [(i, i + 1, 6.0) for i in range(1, n)]


def test_encoder_block_against_loops(spark):
    rng = np.random.default_rng(8)
    width, heads, inner, n = 8, 2, 6, 5
    draw = lambda *shape: rng.normal(size=shape) / 3
    layer = encoder.Layer(draw(3 * width, width), draw(width, width), (draw(width), draw(width)), draw(inner, width), draw(inner, width), draw(width, inner), (draw(width), draw(width)))
    start, x = (draw(width), draw(width)), rng.normal(size=(n, width))

    def norm(row, scale, shift):
        mean = sum(row) / width
        spread = math.sqrt(sum((v - mean) ** 2 for v in row) / width + 1e-12)
        return [(v - mean) / spread * scale[i] + shift[i] for i, v in enumerate(row)]

    def turn(row, place):
        half = len(row) // 2
        out = list(row)
        for i in range(half):
            angle = place / 10000.0 ** (2 * i / len(row))
            out[i], out[i + half] = row[i] * math.cos(angle) - row[i + half] * math.sin(angle), row[i] * math.sin(angle) + row[i + half] * math.cos(angle)
        return out

    rows = [norm(r, *start) for r in x]
    made = [[sum(w * v for w, v in zip(line, r)) for line in layer.qkv] for r in rows]
    size, mixed = width // heads, []
    for t in range(n):
        whole = []
        for h in range(heads):
            part = lambda r, k, h=h: r[k * width + h * size : k * width + (h + 1) * size]
            q = turn(part(made[t], 0), t)
            scores = [math.exp(sum(a * b for a, b in zip(q, turn(part(made[s], 1), s))) / math.sqrt(size)) for s in range(n)]
            whole += [sum(w * part(made[s], 2)[d] for s, w in enumerate(scores)) / sum(scores) for d in range(size)]
        mixed.append([sum(w * v for w, v in zip(line, whole)) for line in layer.mix])
    rows = [norm([a + b for a, b in zip(r, m)], *layer.norm_one) for r, m in zip(rows, mixed)]
    out = []
    for r in rows:
        gate = [sum(w * v for w, v in zip(line, r)) for line in layer.gate]
        value = [sum(w * v for w, v in zip(line, r)) * g / (1 + math.exp(-g)) for line, g in zip(layer.value, gate)]
        out.append(norm([a + sum(w * v for w, v in zip(line, value)) for a, line in zip(r, layer.out)], *layer.norm_two))
    mean = [sum(r[i] for r in out) / n for i in range(width)]
    length = math.sqrt(sum(v * v for v in mean))
    table = spark.createDataFrame([(1, x.tolist()), (2, [])], "id long, vectors array<array<double>>")
    got = encoder.encode_sequences(table, [layer], heads, start).collect()
    assert len(got) == 1 and got[0].vec == pytest.approx([v / length for v in mean])
