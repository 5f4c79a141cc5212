import numpy as np

from evispark.llm import language

WORDS = {"en": "the and that with thing shall would".split(), "de": "der und nicht schön über gewiß ich".split()}


def _rows(n, seed):
    rng = np.random.default_rng(seed)
    return [(k, " ".join(rng.choice(WORDS[lang], 30)), lang) for k in range(n) for lang in [("en", "de")[k % 2]]]


def test_held_out_languages_are_predicted(spark):
    docs = spark.createDataFrame(_rows(400, 0), "doc_id bigint, text string, lang string")
    out = language.predict_documents(docs, language.learn(docs)).join(docs, "doc_id").toPandas()
    assert (out.lang_pred == out.lang).mean() > 0.97 and out.score.between(0, 1).all()


def test_tables_give_the_responses_of_the_filters():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (5, language.WINDOW)).astype(np.uint8)
    net = language.train(x, np.array([0, 1, 0, 1, 0]), ["a", "b"], epochs=1).fold()
    pooled = []
    for w, f in net.filters.items():
        e = net.embed[x]
        pooled.append(sum(e[:, k : language.WINDOW - w + 1 + k] @ f[k] for k in range(w)).max(axis=1))
    z = np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0) @ net.out + net.out_bias
    want = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    np.testing.assert_allclose(net.log_probabilities(x), want, atol=1e-3)


def test_windows_cover_the_whole_text():
    data = bytes(range(256)) * 3
    w = language.windows(data)
    assert w[:-1].tobytes() == data[: len(w[:-1]) * language.WINDOW] and w[-1].tobytes() == data[-language.WINDOW :]


def test_edges(spark, edge_docs, no_docs):
    out = {(r.doc_id, r.lang_pred) for r in language.predict_documents(edge_docs, language.learn(edge_docs)).collect()}
    assert (2, "und") in out and (3, "und") in out and len(out) >= 6
    assert language.predict_documents(no_docs, language.learn(no_docs)).count() == 0


def test_a_prediction_is_that_of_loops_over_places_and_filters():
    rng = np.random.default_rng(9)
    x = rng.integers(97, 123, (40, language.WINDOW)).astype(np.uint8)
    net = language.train(x, np.arange(40) % 3, ["a", "b", "c"], epochs=2)
    text = "".join(map(chr, rng.integers(97, 123, 450)))
    logs = []
    for window in language.windows(text.encode()):
        pooled = []
        for width, f in net.filters.items():
            for k in range(f.shape[2]):
                pooled.append(max(sum(float(net.embed[window[p + i]] @ f[i, :, k]) for i in range(width)) for p in range(len(window) - width + 1)))
        z = np.maximum(np.array(pooled) + net.bias, 0) @ net.out + net.out_bias
        logs.append(z - z.max() - np.log(np.exp(z - z.max()).sum()))
    p = np.exp(np.mean(logs, axis=0))
    names, scores = net.fold().predict([text, None, "123"])
    assert names == [net.names[int(p.argmax())], "und", "und"]
    assert abs(scores[0] - p.max() / p.sum()) < 1e-3 and scores[1] == scores[2] == 0
