"""The corpus pipeline on small tables: each stage keeps what it should."""

import pytest


def test_pipeline_imports_and_runs(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import random

    rng = random.Random(1)
    words = {"en": "the of and to in is that with for on by are was this have from at not", "fr": "le la les de des et que pour dans une sur est pas par qui au il elle"}
    rows = []
    for i in range(120):
        lang = rng.choice(list(words))
        text = ". ".join(" ".join(rng.choice(words[lang].split()) + rng.choice(["", "s", "er", "a"]) for _ in range(9)) for _ in range(12))
        rows.append((i, text, lang, "src", len(text)))
    rows.append((500, rows[0][1] + " extra", "en", "src", 0))  # a near copy
    rows.append((501, "1 2 3 4 5 6 7 8 9 10 11 12", "en", "src", 0))  # no language
    rows.append((502, rows[1][1] + " password=abcdefgh99", "fr", "src", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
    left = {r["doc_id"]: r["text"] for r in at.collect()}
    assert 501 not in left and 500 not in left and 502 not in left and 0 in left
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == set(left)


def test_every_stage_on_odd_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import random

    rng = random.Random(2)
    words = {"en": "the of and to in is that with for on by are was this have from at not", "fr": "le la les de des et que pour dans une sur est pas par qui au il elle"}
    clash = ["kept", "quality", "lang_pred", "score", "n_words", "shingles", "component_id", "__text", "__kept", "spans", "rank"]
    rows = []
    for i in range(60):
        lang = rng.choice(list(words))
        text = ". ".join(" ".join(rng.choice(words[lang].split()) + rng.choice(["", "s", "er", "a"]) for _ in range(9)) for _ in range(12))
        rows.append((i, text, lang, "src", len(text), *[f"{c}{i}" for c in clash]))
    rows += [(None, rows[0][1], None, None, None, *[None] * len(clash)), (70, None, "en", None, None, *[None] * len(clash)), (71, "", None, "s", 0, *[None] * len(clash))]
    rows += [rows[1], rows[1], (72, (rows[2][1] + " ") * 3 + "token=abcdefgh1234", "en", "s", 0, *[None] * len(clash))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash))
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at.write.parquet(str(tmp_path / name))
        at = stage(spark, spark.read.parquet(str(tmp_path / name)), str(tmp_path))
        assert at.columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    left = at.collect()
    assert len([r for r in left if r["doc_id"] == 1]) == 1 and not {70, 71} & {r["doc_id"] for r in left}
    original = {r[0]: r for r in rows}
    for r in left:
        if r["doc_id"] is not None:
            assert tuple(r)[5:] == original[r["doc_id"]][5:]
    assert {r["doc_id"] for r in corpus_pipeline.packed(spark, at, "").collect()} == {r["doc_id"] for r in left}


def test_near_dedup_and_packing_take_small_batches_and_hand_memory_back(spark, monkeypatch):
    import pyarrow as pa
    import public_tokenizers

    from lexloom.llm import common, near_duplicates, packing

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own, seen = spark.conf.get(name), []
    for module in (near_duplicates, packing):
        monkeypatch.setattr(module, "stored", lambda df, n, f=module.stored: seen.append(int(spark.conf.get(name))) or f(df, n))
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(20)], "doc_id long, text string")
    assert near_duplicates.group(docs).count() == 20
    assert packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 20
    assert seen and max(seen) <= common.BATCH_ROWS and spark.conf.get(name) == own
    freed = []

    class Pool:
        def release_unused(self):
            freed.append(1)

    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    assert list(common.released(iter)([1, 2])) == [1, 2] and freed == [1]
