import os
import random
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest


from kinlink import catalogue
from kinlink.catalogue.queries import _short_with_tokens, rounded, rounded_cosines
from kinlink.plans.scratch import spread

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
SLOW = {"linkage_end_to_end", "gbt_oof_scores", "streaming_key_matches"}


def values(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6) + 0.0
    return sorted((tuple(None if pd.isna(v) else v for v in r) for r in df.astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", [n for n in catalogue.queries() if n in catalogue.oracle_sql() and n not in SLOW])
def test_query_matches_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    want = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert values(got) == values(want)


@pytest.mark.parametrize("name", [n for n in catalogue.queries() if n not in catalogue.oracle_sql() or n in SLOW])
def test_query_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["token_set_ratio", "string_scores"])
def test_every_part_and_supplier_of_an_order_is_compared(spark, duck, name):
    got = {(r["qi"], r["si"]) for r in catalogue.queries()[name](spark, SF).select("qi", "si").collect()}
    assert got == set(duck.execute("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem").fetchall())


def test_a_small_file_is_worked_on_by_all_cores(spark):
    """Parts are one small file; their tokens are made, and written, by more than one task."""
    assert len(spark.read.parquet(f"{SF}/part.parquet").inputFiles()) == 1
    assert len(_short_with_tokens(spark, SF).inputFiles()) > 1
    many = spark.range(100).repartition(9)
    assert spread(many, "id") is many


def test_cosines_are_rounded_as_all_doubles(spark):
    """Means and differences of cosines of 9 digits, off by an ulp or not; a zero has no sign."""
    rnd = random.Random(5)
    pairs = [(round(rnd.random(), 9), round(rnd.random(), 9)) for _ in range(5000)] + [(0.3, 0.1), (0.2, 0.2), (0.0, 0.0), (1.0, 1.0), (0.000000001, 0.0)]
    means = [(a + b) / 2 for a, b in pairs]
    rows = [(a, m, m - n) for (a, _), m, n in zip(pairs, means, [*means[1:], means[0]])] + [(0.0, -1e-17, 5e-17)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = [tuple(r) for r in rounded_cosines(df).collect()]
    assert repr(got) == repr([tuple(r) for r in rounded(df, 12).collect()])


def test_imports_without_the_corpus_operators(tmp_path):
    """The rest stands alone when the llm folders and the pipeline are deleted."""
    shutil.copytree(f"{ROOT}/kinlink", tmp_path / "kinlink", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_nothing_else_imports_the_corpus_operators():
    for folder, _, names in os.walk(f"{ROOT}/kinlink"):
        if "llm" not in folder.split(os.sep):
            for n in names:
                if n.endswith(".py"):
                    assert "kinlink.llm" not in open(os.path.join(folder, n)).read(), n
