"""The pipeline stage by stage on the smallest table."""

import pytest

import corpus_pipeline
from lattica.llm import common, decontaminate, quality, secret_scan
from lattica.llm.common import fold, kept, table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, tables = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(kept(stage(spark, tables[-1], sf_dir)))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert tables[-1].columns == columns
    first, unique, clean, cut, last = tables[1:]
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1))
    assert sorted(r[0] for r in first.select("doc_id").collect()) == sorted(r["id"] for r in quality.score(docs, model).where("score >= 0.5").collect())
    assert unique.select("text").distinct().count() == unique.count() <= first.count()
    assert decontaminate.contaminated(clean, table(spark, sf_dir, "benchmark")).count() == 0
    assert clean.join(decontaminate.contaminated(unique, table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id"), "doc_id").count() == 0
    assert secret_scan.scan(cut).where("exists(spans, s -> s.base)").count() == 0
    assert cut.count() == clean.count() == last.count()
    assert last.join(cut.select("doc_id", "text"), ["doc_id", "text"]).count() == last.count()
    assert corpus_pipeline.run(spark, sf_dir).count() == last.count()


def test_odd_rows(spark, sf_dir):
    text = "plain words that are long enough to be scored as a text of their own and kept by every stage of this"
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (None, text + " x", None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, text + " token = 0123456789abcdef0123", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = kept(stage(spark, docs, sf_dir))
    ids = sorted(str(r["doc_id"]) for r in docs.collect())
    assert ids == ["1", "2", "None"]  # 3 is empty as 2 is, 4 shares 17 of its 20 shingles with 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


@pytest.mark.parametrize("broadcast_rows", [0, 500_000])
def test_repeated_ids_keep_unlike_texts(spark, sf_dir, monkeypatch, broadcast_rows):
    """Also where rows are looked up in place, as they are beyond the broadcast bound."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast_rows)
    one, two, three = (" ".join(f"{w}{i}" for i in range(60)) for w in ("a", "b", "c"))
    rows = [(1, one), (1, two), (1, two), (1, three), (2, one), (2, three + " more"), (2, "d e f g h i"), (None, one)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()
    want = [(1, one), (1, two), (1, three), (2, "d e f g h i"), (None, one)]
    assert sorted((str(r["doc_id"]), r["text"]) for r in left) == sorted((str(i), t) for i, t in want)
