import corpus_pipeline
import test_packing
import test_setjoin

from kinlink.llm.registry import tokenizer_path

BENCHMARK = "red kettle under seven lamps while nobody in the harbour counted boats or gulls before dawn"


def text(i, n=40):
    return " ".join(f"{'abcdefghij'[k * i % 10]}o{'klmnpqrst'[(k + i) % 9]}e{'uvwxyz'[(k * k + i) % 6]}a" for k in range(n))


def test_stages_match_brute_force(spark, tmp_path):
    rows = [(i, text(i)) for i in range(1, 30)]
    rows += [(100, text(3)), (101, text(4) + " tail"), (102, text(5).replace("oke", "xxx", 1)), (103, "123 !!"), (104, None), (105, ""), (106, text(40) + " " + BENCHMARK + " " + text(41, 9)), (107, text(50))]
    docs = [(i, t, "en", "src0", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, BENCHMARK)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")

    lettered = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    last = {t: i for i, t in sorted(lettered)}
    unique = [(i, t) for i, t in lettered if last[t] == i]
    groups = test_setjoin.brute(unique, 5, 80, 100)
    near = [(i, t) for i, t in unique if groups[i][1] == i]
    clean = [(i, t) for i, t in near if BENCHMARK not in t]
    for (name, stage), want in zip(corpus_pipeline.STAGES, (lettered, unique, near, clean)):
        df = stage(spark, df, str(tmp_path))
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted((r["doc_id"], r["text"]) for r in df.collect()) == sorted(want), name
        df = spark.createDataFrame(df.collect(), df.schema)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in clean} and 106 not in {r["doc_id"] for r in got}
    test_packing.check(clean, got, 4096)
    assert tokenizer_path() == test_packing.PATH


def test_unlabelled_documents_stay(spark, tmp_path):
    df = spark.createDataFrame([(1, "words", None, None, 5), (2, "12", None, None, 2)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.language_id(spark, df, str(tmp_path)).collect()] == [1]


def test_text_in_no_language_is_rejected(spark):
    prose = "the quick harbour master counted all the boats and gulls before dawn while seven lamps burned under the old red bridge"
    rows = [(i, f"{prose} {i}", "en") for i in range(1, 40)] + [(90, "xqz " * 300, None), (91, "xqz qzx", None), (92, "0x1F 77 99", None), (93, prose * 3, None)]
    df = spark.createDataFrame([(i, t, l, "s", len(t)) for i, t, l in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r["doc_id"] for r in corpus_pipeline.language_id(spark, df, "").collect()}
    assert left == {*range(1, 40), 91, 92, 93}


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_lose_no_link(spark):
    text = " ".join(f"w{i}" for i in range(600))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "other words altogether here now")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3]
