"""Golden cases for the scalar expressions (one per trap / regex)."""
import pytest
from pyspark.sql import functions as F

from srcatlas.functions import codefacts as cf
from srcatlas.functions import paths, text


def one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(expr(F.col("v")).alias("o")).first().o


@pytest.mark.parametrize("review,score", [
    ("SCORE: 91", 91), ("Score: 140", 100), ("**Overall Score: 42/100**", 42), ("I give 77/100", 77),
    ("about 55% done", 55), ("no number", 70), ("score:7 99/100", 7), ("SCORE: 0000085", 85),
    ("SCORE: 99999999999999999999999999999999999999999", 100),
])
def test_review_score(spark, review, score):
    assert one(spark, text.review_score, review) == score


@pytest.mark.parametrize("name,suffix", [
    ("a/b.py", ".py"), (".bashrc", ""), ("x/.hidden.py", ".py"), ("noext", ""), ("a.", ""), ("..b", ".b"), ("a.tar.gz", ".gz"),
])
def test_suffix(spark, name, suffix):
    assert one(spark, paths.suffix, name) == suffix


@pytest.mark.parametrize("src,name", [
    ("https://github.com/org/repo.git", "repo"), ("/data/src3", "src3"), ("github.com/o/r.git", "r"),
    ("http://", ""), ("https://h.example.com/a/b/?q=1#f", "b"), ("www.x.com", "www.x.com"),
])
def test_repo_name(spark, src, name):
    assert one(spark, paths.repo_name, src) == name


def test_repo_id(spark):
    import hashlib
    assert one(spark, paths.repo_id, "/data/src3") == "repo_" + hashlib.md5(b"/data/src3").hexdigest()[:12]


def test_clean_response(spark):
    assert one(spark, text.clean_response, "Here you go\n\n# Title\nbody") == "# Title\nbody"
    assert one(spark, text.clean_response, "Based on x\nno heading") == "Based on x\nno heading"
    assert one(spark, text.clean_response, "  # Keep\n") == "# Keep"


def test_placeholder_report(spark):
    out = one(spark, text.placeholder_report, "# {{Project Name}}\nDescribe the thing {{it's}}")
    assert out.splitlines() == [
        "PLACEHOLDER ISSUES DETECTED:",
        "- Found 2 template placeholders: ['Project Name', \"it's\"]",
        "- Template placeholder syntax found",
        "- Template instruction text found",
    ]
    assert one(spark, text.placeholder_report, "clean").startswith("NO PLACEHOLDER ISSUES")


def test_fill_placeholders_case_insensitive_and_literal(spark):
    df = spark.createDataFrame([("{{project name}} at {{Repository-URL}}", "a$1\\b")], "d string, v string")
    vals = {k: F.col("v") for k in ["repo_name", "languages", "frameworks", "repo_source", "project_dir"]}
    assert df.select(text.fill_placeholders("d", vals)).first()[0] == "a$1\\b at a$1\\b"


def test_code_facts(spark):
    src = "def run(x):\n    pass\ndef typed(x) -> int:\nclass A(B):\nfrom os import path, sep\nimport sys\n@app.route('/r')\n@router.post(\"/p\")"
    df = spark.createDataFrame([(src,)], "c string")
    r = df.select(cf.functions("c").alias("f"), cf.classes("c").alias("k"), cf.imports("c").alias("i"),
                  cf.endpoints("c").alias("e")).first()
    assert r.f == ["run"]  # annotated return is not matched
    assert r.k == ["A"]
    assert r.i == ["os", "path", "sys"]
    assert [(e.method, e.path) for e in r.e] == [(None, "/r"), ("post", "/p")]


def test_frameworks_substring(spark):
    assert one(spark, cf.frameworks, "a reaction to Flask") == ["Flask", "React"]


def test_preprocess(spark):
    assert one(spark, text.preprocess, "<b>héllo</b>, wörld-x!") == "héllo  wörld-x "


def test_strip_unicode_space(spark):
    assert one(spark, text.strip, " \t abc 　\n") == "abc"


def test_metadata_path(spark):
    assert one(spark, text.metadata_path, '{"source_file": "a/b.py"}') == "a/b.py"
    assert one(spark, text.metadata_path, "{'source_file': 'a/b.py'}") == ""
    assert one(spark, text.metadata_path, "garbage") == ""


def test_scale_conf():
    from srcatlas.session import scale_conf
    c = scale_conf(100 * 2**40, 8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 409600
    assert int(scale_conf(10, 16)["spark.sql.shuffle.partitions"]) == 32
