import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from vecspark.sources import io, storage


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return f"file://{path}"


def test_expression_files(spark, tmp_path):
    good = write(tmp_path, "a.tsv", "id\tx\ty\ng1\t1\t2\ng2\t3.5\t4\ng9\t0\t0\n")
    odd = write(tmp_path, "b.tsv", "id\tx\ty\ng1\tInf\t2\ng2\tNaN\n")
    ids = spark.createDataFrame([("g1",), ("g2",)], "gene_id string")
    long, rejects = io.read_expression(spark, [good, odd], ids, [2, 3])
    assert {tuple(r) for r in long.collect()} == {("g1", 1, 1.0), ("g1", 2, 2.0), ("g2", 1, 3.5), ("g2", 2, 4.0), ("g1", 4, 2.0)}
    assert sorted((r["gene_id"], r["reason"]) for r in rejects.collect()) == [("g1", "not_finite"), ("g2", "missing_value"), ("g2", "not_finite"), ("g9", "unknown_gene")]
    comma = write(tmp_path, "c.csv", "id,x\n g1 ,7\n")
    assert [tuple(r) for r in io.read_expression(spark, [comma], ids, [2], delimiter=",")[0].collect()] == [("g1", 1, 7.0)]
    assert [r[0] for r in io.read_gene_ids(spark, good).collect()] == ["g1", "g2", "g9"]


def test_orthogroups(spark, tmp_path):
    path = write(tmp_path, "o.tsv", "Orthogroup\ts1\ts2\nOG0\tg1, g2\tg3\nOG1\t\tg2,g4\n")
    got = {r["gene_id"]: r["family_id"] for r in io.read_orthogroups(spark, path).collect()}
    assert got == {"g1": "OG0", "g2": "OG1", "g3": "OG0", "g4": "OG1"}


def test_bundles(spark, tmp_path):
    ids = spark.createDataFrame([("a",)], "gene_id string")
    path = f"file://{tmp_path}/bundle"
    io.save_bundle({"gene_ids": ids}, path)
    tables, unknown = io.load_bundle(spark, path)
    assert set(tables) == {"gene_ids"} and not unknown and tables["gene_ids"].collect() == ids.collect()
    with pytest.raises(ValueError):
        io.save_bundle({"other": ids}, path + "2")
    io.save_table(ids, path + "3")
    assert io.load_table(spark, path + "3", ids.schema).count() == 1
    with pytest.raises(ValueError):
        io.load_table(spark, path + "3", spark.range(1).schema)


def test_stored_tables_can_all_be_dropped(spark):
    df, path = storage.stored(spark.range(3))
    assert path in storage._MADE and df.count() == 3
    kept = storage.stored(spark.range(2))[1]
    storage.dropped(spark, path)
    assert path not in storage._MADE and kept in storage._MADE
    storage.drop_all(spark)
    assert not storage._MADE and not os.path.exists(kept.removeprefix("file://"))


def test_lookups_read_few_files(spark, tmp_path):
    path = f"file://{tmp_path}/bundle"
    genes = spark.range(20_000).selectExpr("id AS gene_id", "id % 7 AS family_id").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # or small ranges would be joined into one file
    try:
        io.save_bundle({"gene_to_family": genes}, path)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    every = [p for p in (tmp_path / "bundle" / "gene_to_family").iterdir() if p.name.startswith("part-")]
    ids = spark.createDataFrame([(17,), (18,), (19,), (None,), (50_000,)], "gene_id long")
    assert len(every) == 4 and len(io.bundle_files(spark, path, "gene_to_family", ids, "gene_id")) == 1
    found = io.lookup_in_bundle(spark, path, "gene_to_family", ids)
    assert sorted(map(tuple, found.collect())) == [(17, 3), (18, 4), (19, 5)] and len(found.inputFiles()) == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gene_id" in plan or "PushedFilters: [IsNotNull(gene_id), In(gene_id" in plan
    many = io.lookup_in_bundle(spark, path, "gene_to_family", spark.range(500, 700).toDF("g"), "g", at_most=10)
    assert many.count() == 200 and len(many.inputFiles()) < 4
    assert io.lookup_in_bundle(spark, path, "gene_to_family", ids.where("gene_id > 30000")).count() == 0


def test_entry_imports_without_the_llm_folders(tmp_path):
    here, copy = Path(__file__).resolve().parent.parent, tmp_path / "copy"
    shutil.copytree(here, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'detect_outliers' in q and 'pipeline' not in q; assert not any(x.startswith('op') for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
