import zlib

import numpy as np

from quillstrata.llm import byte_cnn as C
from quillstrata.llm import knn_quality as K

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = C.report(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.95 and got.score.between(0, 1).all()


def test_language_edges(spark, frame):
    net = C.Network.fit(["der die das und ist nicht " * 40] * 60 + ["the and of with is not " * 40] * 60, ["de"] * 60 + ["en"] * 60)
    got = {r.doc_id: (r.lang_pred, r.score) for r in C.predict(frame([None, "", "123 !?", "the and of " * 3000, "x"]), net).collect()}
    assert [got[i] for i in range(3)] == [("und", 0.0)] * 3 and got[3][0] == "en" and 0 < got[4][1] <= 1
    assert C.report(frame([])).count() == 0
    assert [r.lang_pred for r in C.predict(frame(["the"]), None).collect()] == ["und"]
    docs = frame([None, "the and of with", "the and of with"], [1, 2, 2]).withColumnRenamed("term", "extra")
    kept = C.keep_known(docs, net, 0.3)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 2]


def test_tables_equal_the_convolution():
    net = C.Network.fit(["der die das " * 30, "the and of " * 30], ["de", "en"])
    x = np.concatenate([C.windows(t.encode())[0] for t in ("the die é漢", "und of " * 200)])
    e, pooled = net.embed[x], []
    for w, k in zip(C.WIDTHS, net.kernels, strict=True):
        pooled.append((np.concatenate([e[:, j : C.WINDOW - w + 1 + j] for j in range(w)], axis=2) @ k).max(1))
    z = np.maximum(np.concatenate(pooled, 1) + net.bias, 0) @ net.out + net.out_bias
    z -= z.max(1, keepdims=True)
    assert np.allclose(z - np.log(np.exp(z).sum(1, keepdims=True)), net.scorer()(x), atol=1e-4)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = C.Network.fit(["ab cd " * 30, "xy zw " * 30], ["a", "b"])
    x, y = rng.integers(1, 255, (4, C.WINDOW)).astype(np.uint8), np.array([0, 1, 1, 0])
    loss = lambda: -net.scorer()(x)[np.arange(4), y].mean()
    grads = net._gradients(x, y)
    for p, g in ((net.bias, grads[4]), (net.out, grads[5]), (net.out_bias, grads[6]), (net.kernels[1], grads[2])):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, h = p[at], 1e-2
        p[at] = old + h
        up = loss()
        p[at] = old - h
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * h) - g[at]) < 0.05 * abs(g[at]) + 1e-3


def test_windows_cover_every_byte():
    for n in (0, 1, 3, 252, 253, 254, 256, 257, 1000):
        data = bytes(1 + i % 255 for i in range(n))
        w, sizes = C.windows(data)
        seen = {bytes(x[i : i + 4]) for x in w for i in range(C.WINDOW - 3)}
        assert all(data[i : i + 4] in seen for i in range(n - 3)) and sizes.sum() >= n - 3


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = K.report(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (held.predicted == held.quality).mean() > 0.95 and ((got.score >= 0.7) == (got.predicted == 1)).all()


def test_quality_edges(spark, frame):
    docs = frame([None, "", "good words in a row " * 20, "$$ %% ## " * 20, "good words in a row " * 20, "word " * 20_000], [0, 1, 3, 4, 3, 9])
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (4, 0, 0), (3, None, 0), (77, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = [(r.doc_id, r.score) for r in K.report(docs, labels).orderBy("doc_id").collect()]
    assert len(got) == 6 and all(0 <= s <= 1 for _, s in got)
    scores = dict(got)
    assert scores[0] == scores[1] and scores[3] > scores[4]
    assert {r.score for r in K.report(docs, labels.limit(0)).collect()} == {0.5}
    assert K.report(frame([]), labels).count() == 0


def test_neighbours_equal_a_plain_loop():
    rng = np.random.default_rng(1)
    x, y = rng.random((60, K.HASHED + K.STYLE)).astype(np.float32), rng.integers(0, 2, 60)
    m = K.Neighbours.fit(x, y, 0.8)
    q = rng.random((5, K.HASHED + K.STYLE)).astype(np.float32)
    cos = m._unit(m._scaled(q, m.idf) @ m.basis) @ m.vectors.T
    for row, got in zip(cos, m.score(q), strict=True):
        near = sorted(range(60), key=lambda i: -row[i])[: K.NEAREST]
        w = [max(row[i], 0) ** K.SHARPNESS * m.weights[i] for i in near]
        assert abs(got - (sum(a * m.labels[i] for a, i in zip(w, near, strict=True)) + 0.1 * 0.8) / (sum(w) + 0.1)) < 1e-4
