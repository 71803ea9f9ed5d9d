import numpy as np
import pytest

from stratacut.llm import quality, toxicity


def accuracy(out, labels, column):
    rows = out.join(labels, "doc_id").where(f"held_out and {column} is not null").select("predicted", column).collect()
    return sum(r[0] == r[1] for r in rows) / len(rows)


@pytest.mark.parametrize(("module", "column", "least"), [(quality, "quality", 0.97), (toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, module, column, least):
    sf = "/root/testdata/sf0.01"
    out = module.query(spark, sf)
    assert out.count() == 1000 and out.where("score is null or score < 0 or score > 1").count() == 0
    assert accuracy(out, spark.read.parquet(f"{sf}/labels.parquet"), column) >= least


@pytest.mark.parametrize(("module", "name", "column"), [(quality, "quality", "quality_score"), (toxicity, "toxicity", "toxic_score")])
def test_edges(spark, module, name, column):
    docs = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (2, "", 0.0), (3, "idiot " * 20_000, 0.0), (4, "plain and good", 0.0), (None, "plain", 0.0)], f"doc_id long, text string, {column} double")
    labels = spark.createDataFrame([(3, 0, 1), (4, 1, 0), (2, None, None), (9, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = getattr(module, name)(docs, labels)
    assert out.columns[-1] == f"{column}_"
    assert out.count() == 6 and out.where(f"{column}_ between 0 and 1").count() == 6
    assert getattr(module, name)(docs, labels.limit(0)).count() == 6
    assert getattr(module, name)(docs.limit(0), labels).count() == 0


def test_every_byte_counts():
    """Summaries see the whole text and nothing else: they equal the ones of a plain loop over its own overlapping chunks."""
    net = quality.ByteNet()
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(32, 127, n).astype(np.uint8)) for n in (0, 5, 128, 129, 700, 90_000)]
    for text, row in zip(texts, net.summaries(texts), strict=True):
        n = max(1, -(-len(text) // 128))
        own = np.append(np.frombuffer(text, np.uint8).astype(int), np.full(n * 128 + quality.WIDE - len(text), quality.PAD))
        pooled = [np.max([net.p["embed"][own[i : i + quality.WIDE]].reshape(-1) @ net.p["filters"] for i in range(k * 128, k * 128 + 128, 2)], 0) for k in range(n)]
        z = [float(net.head((np.maximum(pooled[k], pooled[k + 1]) if n > 1 else pooled[0])[None])[2][0]) for k in range(max(1, n - 1))]
        assert row == pytest.approx([np.mean(z), max(z), min(z), np.std(z), np.mean(np.array(z) > 0)], abs=1e-3)


def test_equal_texts_score_equal_in_any_company():
    net = quality.ByteNet()
    net.mix = np.array([0.1, 0.4, 0.2, 0.3, 0.5, 0.1])
    rng = np.random.default_rng(4)
    t, a, b = (bytes(rng.integers(32, 127, n).astype(np.uint8)) for n in (256, 3000, 90_000))
    alone = net.score([t])[0]
    for company in ([t, a], [a, t], [t] * 5 + [a], [b, t, b, t], [b"", t, b""]):
        scores = net.score(company)
        assert all(s == alone for x, s in zip(company, scores.tolist(), strict=True) if x == t)


def test_risk_needs_no_clean_labels(spark):
    """Toxic words are told apart though half of the unlabelled text is toxic too, from counts that equal plain ones."""
    rng = np.random.default_rng(2)
    common = [f"w{chr(97 + k)}xyz" for k in range(26)]
    document = lambda bad: " ".join([*rng.choice(common, 12), *(["nastyword"] if bad else [])])
    rows = [(k, document(k % 2 == 0), int(k % 2 == 0), k < 200) for k in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[3]], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    keys = np.unique(np.concatenate([toxicity.features_of(r[1].encode()) for r in rows]))
    n, total = toxicity.counted(docs.select(docs.text.cast("binary").alias("text")), keys)
    assert total == 600 and n.tolist() == [sum(k in toxicity.features_of(r[1].encode()) for r in rows) for k in keys.tolist()]
    scores = model.score([document(True).encode(), document(False).encode(), b""])
    assert scores[0] > 0.3 > 0.2 > scores[1] and scores[2] < 0.3


def test_non_negative_risk():
    """The steps end where the risk's gradient, worked out anew by differences, is flat in the bias."""
    rng = np.random.default_rng(3)
    toxic = np.column_stack([np.ones(50), rng.uniform(2, 4, (50, 3)), rng.normal(0, 0.1, 50)])
    clean = np.column_stack([np.ones(150), rng.uniform(0, 1, (150, 3)), rng.normal(0, 0.1, 150)])
    unlabelled, times = np.concatenate([toxic[:25], clean]), np.ones(175)
    model = toxicity.Toxicity()
    model.fit(toxic, unlabelled, times, 1 / 7)
    model.empty = False

    def risk(out):
        soft = lambda z: np.logaddexp(0, z)
        return soft(-(toxic @ out)).mean() / 7 + max(0, soft(unlabelled @ out).mean() - soft(toxic @ out).mean() / 7)

    assert risk(model.out) < 0.5 * risk(toxicity.Toxicity().out)
    assert (toxic @ model.out).min() > (clean @ model.out).max()
