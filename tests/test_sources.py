import os

import duckdb
import pytest
from pyspark.sql import datasource as DS
from pyspark.sql import functions as F

from auditgrid.config import Config
from auditgrid.plans import corpus, registry
from auditgrid.schema import FILES_DDL
from auditgrid.sources import files as S
from auditgrid.streaming import incremental


def test_folder_source_reads_hidden_files(spark, tmp_path):
    for path, text in {"a.js": "x", ".env": "K=1", ".github/w.yml": "y", "sub/.gitignore": "z", "node_modules/b.js": "no", "skip/c.js": "no", "d.png": "no", "empty.js": "", "sub/e.TS": "é"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "bad.py").write_bytes(b"\xff\xfeok")
    got = {r.relative_path: r.content for r in S.folder(spark, str(tmp_path), "me", ("skip",)).collect()}
    assert got == {"a.js": "x", ".env": "K=1", ".github/w.yml": "y", "sub/.gitignore": "z", "sub/e.TS": "é", "bad.py": "��ok"}
    assert S.folder(spark, str(tmp_path), "me").select("file_id").distinct().count() == 7


def test_scan_predicate(spark):
    rows = [("a.js", "x", True), ("a.PNG", "x", False), (".env", "x", True), ("dist/a.js", "x", False), ("dist", "x", False), ("x/Dockerfile", "x", True), ("a.js", "", False), ("a.js", "x" * (2 * 1024 * 1024 + 1), False), ("own/a.js", "x", False), ("x.lock", "x", True)]
    df = spark.createDataFrame(rows, "p string, c string, want boolean")
    assert all(r[0] == r[1] for r in df.select("want", S.scan_predicate(F.col("p"), F.col("c"), ("own/",))).collect())


def test_targets_and_errors(spark):
    want = {"https://github.com/o/r": ("o", "r"), "github.com/o/r.git": ("o", "r"), "o/r": ("o", "r"), "./x/y": (None, None), "dir/sub": ("dir", "sub"), "o/r/s": (None, None), "git@github.com:o/r.git": (None, None), "https://example.org/o/r": (None, None), "a b/c": (None, None)}
    targets = spark.createDataFrame([(t,) for t in want], "target string").select("target", S.parse_target(F.col("target")).alias("t")).collect()
    assert {r.target: (r.t and r.t.owner, r.t and r.t.repo) for r in targets} == want
    rows = [(429, None, "x", None, None, True, None), (403, "0", "x", "5", None, True, 5000), (403, "9", "Secondary Rate Limit", None, 110, True, 10000), (403, "9", "no", None, 90, False, 0), (404, None, None, None, None, False, None)]
    df = spark.createDataFrame(rows, "s int, r string, b string, retry string, reset long, limited boolean, wait long")
    got = df.select("limited", "wait", S.client_error(F.col("s"), F.col("r"), F.col("b"), F.col("retry"), F.col("reset"), F.lit(100)).alias("e")).collect()
    assert all(r.limited == r.e.rate_limited and r.wait == r.e.retry_after_ms for r in got)


def test_stream_writes_each_batch_once(spark, tmp_path):
    at = f"file://{tmp_path}"
    rows = [(i, "r", f"f{i}.js", "createHash('md5')") for i in range(6)]
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, FILES_DDL).coalesce(1).write.mode("append").parquet(f"{at}/landing")
        incremental.audit_stream(incremental.file_stream(spark, f"{at}/landing", 1), f"{at}/out", f"{at}/state", Config(rules=("weak-hashing",))).awaitTermination()
    assert sorted(r.file_id for r in spark.read.parquet(f"{at}/out").collect()) == list(range(6))


def test_corpus_is_whole(spark):
    sf = "/root/testdata/sf0.001"
    files, docs = corpus.files(spark, sf), spark.read.parquet(f"{sf}/documents.parquet")
    json = files.where("relative_path like '%.json'").count()  # their documents' texts have files of their own
    assert json > 0 and files.count() == docs.count() + json


@pytest.mark.parametrize("name", ["rule_weak_hashing", "rule_hardcoded_ip", "rule_mfa_bypass", "rule_missing_gitignore", "rule_exposed_database_port", "rule_install_script_dependency", "suppress_antijoin", "agg_by_owasp", "file_classes"])
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = [tuple(r[c] for c in names) for r in registry.queries()[name](spark, sf).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want.fetchall())) and got


def test_filters_reach_the_files(spark, tmp_path, monkeypatch):
    for p in ("a.js", "src/b.ts", "src/deep/c.ts", "src/deep/d.py", "srcs/e.ts", "lib/f.js"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    every = {"a.js", "src/b.ts", "src/deep/c.ts", "src/deep/d.py", "srcs/e.ts", "lib/f.js"}
    path = ("relative_path",)
    cases = [
        ([DS.StringStartsWith(path, "src/")], {"src/b.ts", "src/deep/c.ts", "src/deep/d.py"}), ([DS.EqualTo(path, "src/b.ts")], {"src/b.ts"}), ([DS.In(path, ("a.js", "lib/f.js", "no"))], {"a.js", "lib/f.js"}),
        ([DS.StringEndsWith(path, ".ts"), DS.StringContains(path, "deep")], {"src/deep/c.ts"}), ([DS.EqualTo(("repo",), "other")], set()), ([DS.EqualTo(("repo",), "r")], every), ([DS.GreaterThan(("file_id",), 0)], every), ([DS.StringStartsWith(path, "s")], {p for p in every if p.startswith("s")}),
    ]
    opened = []
    real = open
    monkeypatch.setattr("builtins.open", lambda p, *a, **k: (opened.append(str(p)), real(p, *a, **k))[1])
    for filters, want in cases:
        reader = S._FolderReader({"path": str(tmp_path), "repo": "r", "partitions": "3"})
        left = list(reader.pushFilters(filters))
        assert left == [f for f in filters if isinstance(f, DS.GreaterThan)]
        opened.clear()
        assert {row[2] for part in reader.partitions() for row in reader.read(part)} == want
        assert {os.path.relpath(p, tmp_path) for p in opened if p.startswith(str(tmp_path))} == want
    monkeypatch.undo()
    found = S.folder(spark, str(tmp_path), "r").where("relative_path like 'src/%' and content <> 'src/b.ts'")
    assert {r.relative_path for r in found.collect()} == {"src/deep/c.ts", "src/deep/d.py"}
