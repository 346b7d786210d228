"""The tower over arrays, against its exported graph, and models over frames."""

import numpy as np
import pytest

from tessera.models import run, tower
from tessera.operators import images

SMALL = tower.Config(dim=6, stem=4, patch=4, channels=(4, 8), blocks=(1, 2))


def test_exported_tower_is_the_tower():
    onnxruntime = pytest.importorskip("onnxruntime")
    weights = tower.new_weights(SMALL, 1)
    for name in weights:
        if name.endswith(".part"):
            weights[name] = np.random.default_rng(2).uniform(0.5, 1, weights[name].shape).astype(np.float32)
    x = np.random.default_rng(3).normal(size=(1, 3, 32, 32)).astype(np.float32)
    spatial, pooled = tower.evaluate(x.astype(np.float64), weights, SMALL)
    session = onnxruntime.InferenceSession(tower.export(weights, SMALL, 32), providers=["CPUExecutionProvider"])
    got = session.run(["spatial_features", "pooled"], {"pixel_values": x})
    assert spatial.shape == (1, 6, 4, 4) and got[0].shape == spatial.shape
    assert np.allclose(got[0], spatial, atol=1e-4) and np.allclose(got[1], pooled, atol=1e-4)
    assert np.allclose(pooled, spatial.mean(axis=(2, 3)))


def test_a_new_tower_is_nearly_without_its_blocks():
    weights = tower.new_weights(SMALL)
    x = np.random.default_rng(4).normal(size=(2, 3, 16, 16))
    bare = weights | {k: np.zeros_like(v) for k, v in weights.items() if k.endswith(".part")}
    assert np.allclose(tower.evaluate(x, weights, SMALL)[0], tower.evaluate(x, bare, SMALL)[0], atol=1e-4)


def test_convolution_by_definition():
    rng = np.random.default_rng(5)
    x, w, b = rng.normal(size=(1, 2, 5, 6)), rng.normal(size=(3, 2, 2, 2)), rng.normal(size=3)
    got = tower.OnArrays.conv(x, w, b, stride=2, pad=1)
    wide = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    for o in range(3):
        for i in range(got.shape[2]):
            for k in range(got.shape[3]):
                assert got[0, o, i, k] == pytest.approx((wide[0, :, 2 * i : 2 * i + 2, 2 * k : 2 * k + 2] * w[o]).sum() + b[o])


def test_prediction_head():
    x = np.array([[1.0, -1.0]])
    assert tower.predicted(x, (np.eye(2), np.zeros(2)), (np.ones((1, 2)), np.ones(1))).tolist() == [[2.0]]


def test_tower_over_stored_images(spark):
    weights = tower.new_weights(SMALL, 1)
    image = np.random.default_rng(6).integers(0, 256, (20, 32, 3)).astype(np.uint8)
    df = spark.createDataFrame([(7, 32, 20, bytearray(image.tobytes()))], "item long, width int, height int, pixels binary")
    got = images.run_onnx(images.encode_images(df, 32), tower.export(weights, SMALL, 32), 32).first()
    content, box = images.encode_content(image, 32)
    spatial, _ = tower.evaluate(images.reconstruct(content, box, 32)[None].astype(np.float64), weights, SMALL)
    assert got["item"] == 7 and np.allclose(got["v"], images.pool(spatial[0], box, 32), atol=1e-4)


def test_devices():
    assert run.devices(["CPUExecutionProvider", "CUDAExecutionProvider"])[0] == "CUDAExecutionProvider" and run.devices([]) == ["CPUExecutionProvider"]


def plain_epochs(x, y, held, w, epochs, rate):
    """Full passes of Adam over all rows, and the losses before each."""
    m = v = np.zeros_like(w)
    losses = []
    for t in range(1, epochs + 1):
        z = y * (x @ w.T)
        losses.append((np.logaddexp(0, -z[~held]).mean(), np.logaddexp(0, -z[held]).mean()))
        g = (-y / (1 + np.exp(z)))[~held].T @ x[~held] / (~held).sum() / len(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w, losses


def test_row_training_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    from tessera.operators import training

    rng = np.random.default_rng(7)
    x, w = rng.normal(size=(60, 4)), rng.normal(size=(3, 4)) * 0.01
    own = [[int(k) for k in range(3) if x[i, k] > 0.3] for i in range(60)]
    held = np.arange(60) % 5 == 0
    items = spark.createDataFrame([(x[i].tolist(), own[i], bool(held[i])) for i in range(60)], "v array<double>, rows array<long>, validation boolean")
    rows = spark.createDataFrame([(k, w[k].tolist()) for k in range(3)], "row_index long, v array<double>")
    y = np.array([[1.0 if k in own[i] else -1.0 for k in range(3)] for i in range(60)])
    want, losses = plain_epochs(x, y, held, w, 4, 0.05)
    for block in (100, 8):  # all rows at once, and two at a time
        monkeypatch.setattr(training, "BLOCK_VALUES", block)
        run_ = training.RowTraining(spark, str(tmp_path / f"t{block}"))
        run_.start(rows)
        run_.run(items, 2)
        again = training.RowTraining(spark, str(tmp_path / f"t{block}"))
        again.start(rows.limit(0))  # it has begun
        got = {r["row_index"]: r["v"] for r in again.run(items, 4).collect()}
        assert np.allclose([got[k] for k in range(3)], want)
        said = again.losses.read().orderBy("epoch").collect()
        assert np.allclose([(r["loss"], r["held_loss"]) for r in said], losses) and losses[3][1] < losses[0][1]


def test_row_training_stops(spark, tmp_path):
    from tessera.operators import training

    items = spark.createDataFrame([([1.0, 0.0], [0], False), ([1.0, 0.0], [], True)], "v array<double>, rows array<long>, validation boolean")
    work = training.RowTraining(spark, str(tmp_path / "s"), rate=0.5, patience=2)
    work.start(spark.createDataFrame([(0, [0.0, 0.0])], "row_index long, v array<double>"))
    work.run(items, 50)
    assert work.rows.version() == 3 and work.stopped()  # the first loss is the best, then two that are worse
