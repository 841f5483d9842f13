"""The corpus pipeline against its parts by brute force on a small table."""

from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tests.llm.test_operators import ODD, WORDS, brute_components, check_packing, encoded, none, odd  # noqa: E402, F401


def test_stages_take_effect(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, d).write.parquet(str(tmp_path / name))
        docs = out[name] = spark.read.parquet(str(tmp_path / name))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(out[n].columns == out["start"].columns for n in names[:-1])
    rows = {n: out[n].collect() for n in out}
    assert {r["doc_id"] for r in rows["language_id"]} == {r["doc_id"] for r in rows["start"]}  # all clean texts have letters
    texts = Counter(r["text"] for r in rows["exact_dedup"])
    assert set(texts) == {r["text"] for r in rows["language_id"]} and set(texts.values()) == {1}
    want = {c for _, c in brute_components([(r["doc_id"], r["text"]) for r in rows["exact_dedup"]], 5, 80).values()}
    assert {r["doc_id"] for r in rows["near_dedup"]} == want
    words = lambda rs: sum(len((r["text"] or "").split()) for r in rs)
    assert words(rows["mixing"]) == pytest.approx(1.5 * words(rows["near_dedup"]), rel=0.02)
    total = sum(len(encoded(WORDS, r["text"])) for r in rows["mixing"])
    assert sum(r["length"] for r in rows["packing"]) == total


def test_run_returns_the_last_stage(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_stages_take_odd_rows(spark, sf_dir):
    """Nulls, empty and very long texts, repeated rows, an empty table, and columns with the operators' own names."""
    df = odd(spark)
    kept = {"language_id": {1, 2, 6, 7, 8, None}, "exact_dedup": {2, 4, 5, 6, 7, 8, None}, "near_dedup": {1, 3, 4, 5, 6, 7, 8, None}, "mixing": None, "packing": set(r[0] for r in ODD)}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, sf_dir)
        rows = out.collect()
        assert kept[name] is None or {r["doc_id"] for r in rows} == kept[name], name
        assert name == "packing" or out.schema == df.schema and all(r["uid"] == "x" for r in rows), name
        assert stage(spark, none(spark), sf_dir).count() == 0, name


def test_language_stage_asks_the_model(spark, sf_dir, monkeypatch):
    """Which rows stay follows from the decoded languages, not from letters alone."""
    from oddsmill.llm import language_id

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50)
    model = {"names": ["a", "und"], "code": language_id.codewords(2), "w": language_id.np.full((language_id.BUCKETS, 1), -1.0, "f4"), "weights": language_id.np.ones(1, "f4")}
    answers = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, model).collect()}
    assert set(answers.values()) >= {"und"}
    assert {r["doc_id"] for r in language_id.known_only(docs, model).collect()} == {i for i, lang in answers.items() if lang != "und"}
