"""The pipeline against plain versions of its stages, one after the other, on a small table."""

import random

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
import plain  # noqa: E402

from lingloom.llm import mixing, quality  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(600)]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(30, 80))).capitalize() + "."
    items = [(k, text()) for k in range(5)]
    docs = [(k, text() + (" a vile slur for you" if k % 9 == 4 else "")) for k in range(160)]
    docs += [(200 + k, "\n" + docs[k][1]) for k in range(10)]
    docs += [(300 + k, docs[20 + k][1] + " more") for k in range(10)]
    docs += [(400 + k, docs[40 + k][1] + " " + items[k % 5][1]) for k in range(10)]
    docs += [(500 + k, " ".join(w + "###" for w in text().split())) for k in range(60)]
    docs += [(600, None), (601, "")]
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or ""), "extra") for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, digest string").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(not 500 <= i < 600), int("vile" in (t or ""))) for i, t in docs if i % 4], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages_are_brute_force(spark, folder):
    """Each stage on what the stage before kept: the second to the fourth by plain Python, the first by its scores, the last by its targets."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, bench = spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    names, stages = zip(*corpus_pipeline.STAGES, strict=True)
    assert len(names) == 5
    items = [plain.spoken(r.text) for r in bench.collect()]
    kept = [
        lambda rows: {r.doc_id for r in quality.classify(docs, labels).where("score >= 0.7").collect()},
        plain.best_of_equal,
        lambda rows: {i for i, (_, c) in plain.components(rows).items() if i == c},
        lambda rows: {i for i, t in rows if not any(plain.overlap(plain.spoken(t), item) for item in items)},
    ]
    for k, stage in enumerate(stages[:-1]):
        want = kept[k]([(r.doc_id, r.text) for r in docs.collect()])
        out = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert {r.doc_id for r in out.collect()} == want and out.columns == docs.columns, names[k]
        assert out.count() < docs.count()
        docs = out
    text_of = {r.doc_id: r.text for r in docs.collect()}
    ids = set(text_of)
    assert not ids & {*range(10), *range(300, 310), *range(400, 410), *range(500, 560)} and ids >= {*range(10, 160), *range(200, 210)}
    mix = stages[-1](spark, docs, folder)
    rows = mix.collect()
    assert {r.doc_id for r in rows} <= ids and all(r.copies > 0 for r in rows)
    whole = mixing.mixed_rates(docs, labels.select("doc_id", mixing.label_domain().alias("domain")), corpus_pipeline.TARGETS).collect()
    assert {(r.doc_id, r.copies) for r in rows} == {(r.doc_id, r.copies) for r in whole if r.copies}
    assert all(r.n_tokens == len(plain.WORD.findall(text_of[r.doc_id] or "")) for r in whole)
    n, p, share = np.array([r.n_tokens for r in whole]), np.array([r.posteriors for r in whole]), np.array([corpus_pipeline.TARGETS[d] for d in sorted(corpus_pipeline.TARGETS)])
    root = np.sqrt(1 / np.maximum(n @ p / n.sum(), 1e-3))
    dense, want = p * (n[:, None] / n.sum()) * root, np.ones(len(n))
    for _ in range(20000):
        want = np.maximum(0, want - dense @ (want @ dense - share * root) / np.linalg.eigvalsh(dense.T @ dense)[-1])
    loss = lambda r: float(((r @ dense - share * root) ** 2).sum())
    assert loss(np.array([r.rate for r in whole])) == pytest.approx(loss(want), abs=1e-3)
    assert {(r.doc_id, r.copies) for r in corpus_pipeline.run(spark, folder).collect()} == {(r.doc_id, r.copies) for r in rows}


def test_pipeline_on_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
