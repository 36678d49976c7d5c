import corpus_pipeline as p
from scorelake.llm import decontamination, near_copies, secrets, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_chain_and_their_decisions_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    steps, at = {}, docs
    for name, stage in p.STAGES:
        stage(spark, at, SF).write.parquet(str(tmp_path / name))
        before, at = at, spark.read.parquet(str(tmp_path / name))
        steps[name] = (before, at)
        if name != "encoding":
            assert at.columns == docs.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = steps["toxicity"]
    model = toxicity.fit(docs, labels)
    assert ids(after) == {r.doc_id for r in toxicity.scored(before, model).collect() if r.score < toxicity.THRESHOLD}
    before, after = steps["near_duplicates"]
    assert ids(after) == {r.component_id for r in near_copies.components(before).collect()}
    before, after = steps["decontamination"]
    assert ids(before) - ids(after) == {r.doc_id for r in decontamination.contaminated(before, items).collect()}
    before, after = steps["secrets"]
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in secrets.scan(before).select("doc_id", "secrets").collect():
        t = texts[r.doc_id]
        for s in sorted(r.secrets, key=lambda s: -s.start):
            assert s.piece == t[s.start : s.end]
    assert ids(after) == ids(before)
    assert secrets.report(after).where("n_assign + n_access + n_hex > 0").count() == 0
    before, after = steps["encoding"]
    assert ids(after) == ids(before) and after.where("not decoded").count() == 0
    assert after.where("sample = 0").count() == before.count()


def awkward(make_docs):
    long = "many calm words in a row that go on " * 20_000
    rows = [(1, None), (2, ""), (3, "..."), (4, "same text here for two rows of it"), (5, "same text here for two rows of it"), (5, "same text here for two rows of it"), (None, "no id token=abcdefgh"), (6, long), (7, "password: hunter22 and more"), (2**62, "漢字 😀 é")]
    return make_docs(rows, _text=1, secrets="s", bad=2, component_id=3, fp=4, score=5, n=6, _row=7)


def test_awkward_rows_and_clashing_columns_pass_every_stage(spark, make_docs, tmp_path):
    at = awkward(make_docs)
    columns = at.columns
    for name, stage in p.STAGES[:-1]:
        stage(spark, at, SF).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        assert at.columns == columns
        assert all((r._text, r.secrets, r.bad, r.component_id, r.fp, r.score, r.n, r._row) == (1, "s", 2, 3, 4, 5, 6, 7) for r in at.collect())
    got = {r.doc_id: r for r in at.collect()}
    assert 4 in got and 5 not in got and got[7].text == "[secret] and more" and got[None].text == "no id [secret]"
    assert 6 in got and got[7].n_chars == len("[secret] and more")
    out = p.STAGES[-1][1](spark, at, SF)
    assert out.where("not decoded").count() == 0 and {r.doc_id for r in out.collect()} >= {6, 7, None}


def test_empty_tables_pass_every_stage(spark, make_docs):
    empty = make_docs([(1, "x")]).limit(0)
    for name, stage in p.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_run_leaves_its_last_table_only(spark, tmp_path):
    import os

    out = p.run(spark, SF)
    assert out.count() > 0 and out.columns[0] == "doc_id"
    folder = os.path.dirname(os.path.dirname(out.inputFiles()[0].removeprefix("file:").replace("///", "/")))
    assert os.listdir(folder) == ["4-encoding"]
