import numpy as np

from spanlight.llm import language as L


def plain(net, row):
    """Probabilities of one window by the definition."""
    x, hidden = net.embedding[row], []
    for w, b in zip(net.filters, net.biases):
        for f in range(w.shape[2]):
            best = max(sum(float(x[i + j] @ w[j, :, f]) for j in range(len(w))) for i in range(len(row) - len(w) + 1))
            hidden.append(max(0.0, best + b[f]))
    z = np.array(hidden) @ net.dense + net.dense_bias
    e = np.exp(z - z.max())
    return e / e.sum()


def random_network(languages=("a", "b", "c")):
    net = L.train(np.zeros((0, L.WINDOW), np.uint8), np.zeros(0, int), list(languages))
    rng = np.random.default_rng(4)
    net.biases = [rng.normal(0, 1, b.shape) for b in net.biases]
    net.dense_bias = rng.normal(0, 1, net.dense_bias.shape)
    return net


def test_tables_equal_the_definition():
    net = random_network()
    rows = np.random.default_rng(1).integers(0, 256, (5, L.WINDOW)).astype(np.uint8)
    got = L.Predictor(net).probabilities(rows)
    assert np.allclose(got, [plain(net, r) for r in rows], atol=1e-4)


def test_gradient_by_differences():
    rng = np.random.default_rng(2)
    net = random_network()
    theta = [net.embedding, *net.filters, *net.biases, net.dense, net.dense_bias]
    rows, y, weight = rng.integers(0, 256, (4, 20)).astype(np.uint8), np.array([0, 1, 2, 1]), np.ones(4)

    def loss():
        n = L._network(theta, net.languages)
        return -np.mean([np.log(plain(n, r)[k]) for r, k in zip(rows, y)])

    for t, g in zip(theta, L._gradient(theta, rows, y, weight)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = t[at], 1e-5
        t[at] = old + step
        up = loss()
        t[at] = old - step
        down = loss()
        t[at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 1e-4


def test_windows_cover_whole_texts():
    for n in (0, 1, 127, 128, 129, 1000):
        text = bytes(97 + k % 26 for k in range(n))
        rows = L.windows(text)
        assert rows.tobytes()[:n] == text and rows.size - n < L.WINDOW + (n == 0)


def test_held_out_accuracy_and_odd_rows(spark):
    got = L.op5_language(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.95 * len(rows)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "12 !? _", 1), (None, "abc", 1), (4, "der die das " * 20_000, 1)], "doc_id long, text string, score int")
    found = {r.id: (r.lang_pred, r.score) for r in L.identify(odd, random_network()).collect()}
    assert [found[k] for k in (1, 2, 3)] == [("und", 0.0)] * 3 and found[None][0] in "abc" and found[4][0] in "abc"
    none = L.fit(odd.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r.lang_pred for r in L.identify(odd, none).collect()} == {"und"}
    assert L.identify(odd.limit(0), none).count() == 0


def test_numerals_are_no_letters():
    net = random_network()
    found = L.Predictor(net).predict(["½ ² ① Ⅷ 12".encode(), "".encode(), "½ é".encode(), "五".encode()])
    assert [x == L.UNKNOWN for x, _ in found] == [True, True, False, False]
