"""File-tree scan, policy, sniffing and decoding on a generated directory."""
import os

import pytest
from pyspark.sql import functions as F

from srcatlas.operators import catalog as cat
from srcatlas.operators import files as fo
from srcatlas.operators.chunking import chunk
from srcatlas.sources import tree


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("trees") / "myrepo"

    def w(rel, data):
        p = root / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data if isinstance(data, bytes) else data.encode("utf-8"))

    w("pkg/__init__.py", "import os\nprint('init module')\n")
    w("_priv/x.py", "def helper(a):\n    return a\n")
    w(".hidden.py", "x = 'hidden but python'\n")
    w(".bashrc", "export A=1 # shell settings\n")
    w(".git/config", "[core]\nbare = false\n")
    w("empty.txt", b"")
    w("latin1.txt", b"caf\xe9 au lait, tr\xe8s bien")
    w("nul.txt", b"a\x00b and more text here")
    w("cyr.txt", "Привет мир, это текст на русском языке " * 5)
    w("crlf.txt", b"a\r\nb line two\r\nc line three")
    w("a/x.py", "def a():\n    pass\n")
    w("a-b/x.py", "def ab():\n    pass\n")
    w("logo.png", b"\x89PNG....")
    w("LICENSE", "MIT licence text here")
    return str(root)


def test_scan_sees_hidden_and_empty(spark, repo):
    rows = {r.rel_path: r for r in tree.scan_tree(spark, [repo]).collect()}
    for rel in ["pkg/__init__.py", "_priv/x.py", ".hidden.py", ".bashrc", ".git/config", "empty.txt"]:
        assert rel in rows, rel
    assert rows["empty.txt"].size_bytes == 0
    assert rows["pkg/__init__.py"].repo == "myrepo"


def test_size_filter_is_pushed(spark, repo):
    df = tree.scan_tree(spark, [repo]).where(F.col("size_bytes") > 0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "empty.txt" not in [r.rel_path for r in df.collect()]
    assert "size_bytes" in plan


def test_ingest_policy_sniff_decode(spark, repo):
    kept = {r.rel_path: r.content for r in tree.ingest_files(spark, [repo]).collect()}
    assert ".hidden.py" in kept and "pkg/__init__.py" in kept and "_priv/x.py" in kept
    for dropped in [".bashrc", ".git/config", "empty.txt", "nul.txt", "cyr.txt", "logo.png", "LICENSE"]:
        assert dropped not in kept, dropped
    assert kept["latin1.txt"].startswith("café au lait")
    assert kept["crlf.txt"] == "a\nb line two\nc line three"


def test_reasons_are_countable(spark, repo):
    listing = tree.scan_tree(spark, [repo])
    with_head = listing.withColumn("head", tree.head(F.col("content")))
    counts = {r.reason: r.n_files for r in fo.policy_counts(with_head, head_col="head").collect()}
    assert counts["nul_byte"] == 1 and counts["not_text"] == 1 and counts["skip_dir"] == 1
    assert counts["binary_ext"] == 1 and counts["empty"] == 1


def test_digest_orders_by_path_parts(spark, repo):
    files = tree.scan_tree(spark, [repo]).withColumn("content", tree.decode_text(F.col("content")))
    d1 = cat.repo_digest(files).first()
    d2 = cat.repo_digest(files).first()
    assert d1.content_hash == d2.content_hash and d1.n_files >= 8
    changed = files.withColumn("content", F.when(F.col("rel_path") == "a/x.py", F.lit("changed")).otherwise(F.col("content")))
    assert cat.repo_digest(changed).first().content_hash != d1.content_hash


def test_documents_and_chunks_from_tree(spark, repo):
    files = tree.ingest_files(spark, [repo])
    docs = fo.build_documents(files, modified_col="modified")
    assert docs.count() == files.where(fo.min_content(F.col("content"))).count()
    assert chunk(docs, mode="buffered").count() >= docs.count()
    with pytest.raises(ValueError):
        chunk(docs, mode="auto")


def test_one_folder_repo_is_split_into_shards(spark, tmp_path):
    root = tmp_path / "deep"
    for i in range(40):
        p = root / "src" / f"pkg{i}" / "mod.py"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"def f{i}():\n    return {i}\n")
    df = tree.scan_tree(spark, [str(root)], shards=8)
    assert df.rdd.getNumPartitions() > 1
    assert df.count() == 40


def test_read_contents_small_batches(spark, repo):
    listing = tree.scan_tree(spark, [repo], content=False)
    full = {r.rel_path: r.content for r in tree.scan_tree(spark, [repo]).collect()}
    got = {r.rel_path: r.content for r in tree.read_contents(listing, max_batch_bytes=16).collect()}
    assert got == full


def test_missing_root_raises(spark, tmp_path):
    with pytest.raises(Exception, match="no such folder"):
        tree.scan_tree(spark, [str(tmp_path / "nowhere")]).count()


def test_unreadable_items_are_rows_and_raise(spark, monkeypatch):
    row = tree._TreeReader({"paths": "/nowhere"}, None)._row("/nowhere", "/nowhere/gone.txt")
    assert row[2] == "gone.txt" and row[3] is None and "FileNotFoundError" in row[-1]
    df = spark.createDataFrame([row, ("r", "/r", "ok.txt", 2, None, b"ok", None)], tree.TREE_SCHEMA)
    assert [r.rel_path for r in tree.readable(df, "skip").collect()] == ["ok.txt"]
    with pytest.raises(Exception, match="gone.txt"):
        tree.readable(df).collect()


def test_caps_can_be_off(spark):
    big = spark.createDataFrame([("big.py", 1 << 40, "some text here")], "rel_path string, size_bytes long, content string")
    for policy in fo.POLICIES:
        assert fo.keep_files(big, policy).count() == 0
        assert fo.keep_files(big, policy, max_bytes=None).count() == 1
        assert fo.keep_files(big, policy, max_bytes=1 << 41).count() == 1
    files = big.withColumn("repo_source", F.lit("/r"))
    other = files.withColumn("content", F.lit("other text here"))
    assert cat.repo_digest(files).first().content_hash != cat.repo_digest(other).first().content_hash


def test_digest_of_bytes_sees_line_ends(spark):
    rows = spark.createDataFrame([("/r", "a.py", 3, bytearray(b"a\r\nb")), ("/r", "b.py", 3, bytearray(b"x"))], "repo_source string, rel_path string, size_bytes long, content binary")
    unix = rows.withColumn("content", F.when(F.col("rel_path") == "a.py", F.lit(bytearray(b"a\nb"))).otherwise(F.col("content")))
    one, two = cat.repo_digest(rows).first(), cat.repo_digest(unix).first()
    assert one.n_files == two.n_files == 2 and one.content_hash != two.content_hash
    assert cat.repo_digest(rows.repartition(7)).first().content_hash == one.content_hash
    assert "collect_list" not in cat.repo_digest(rows)._jdf.queryExecution().executedPlan().toString()


def test_listing_in_rounds_equals_the_scan(spark, repo, tmp_path):
    other = tmp_path / "other"
    for d in ("a/b/c/d/e", "a/b/x", "empty"):
        (other / d).mkdir(parents=True)
    for f in ("top.txt", "a/b/c/d/e/deep.txt", "a/b/x/[odd] name.txt"):
        (other / f).write_text("some text")
    (other / "link").symlink_to(other / "a")
    (other / "link.txt").symlink_to(other / "top.txt")
    roots = [repo, str(other) + "/", repo]
    key = lambda df: sorted((r.repo, r.repo_source, r.rel_path, r.size_bytes, r.modified, r.error) for r in df.collect())
    assert key(tree.list_tree(spark, roots)) == key(tree.scan_tree(spark, [repo, str(other)], content=False))
    with pytest.raises(FileNotFoundError):
        tree.list_tree(spark, [str(tmp_path / "none")])
    (tmp_path / "bare").mkdir()
    assert tree.list_tree(spark, [str(tmp_path / "bare")]).count() == 0


def test_a_flat_folder_is_streamed(spark, tmp_path):
    flat = tmp_path / "flat"
    flat.mkdir()
    for i in range(20_000):
        (flat / f"f{i}.txt").touch()
    assert tree.list_tree(spark, [str(flat)], batch_rows=500).count() == 20_000


def test_what_cannot_be_listed_is_a_row(spark, tmp_path, monkeypatch):
    rows = list(tree._entries(str(tmp_path), "gone"))
    assert len(rows) == 1 and rows[0][2] == "gone" and "FileNotFoundError" in rows[0][5] and not rows[0][6]
    lost = spark.createDataFrame(rows, tree.LISTING).drop("folder")
    assert tree.readable(lost, "skip").count() == 0
    with pytest.raises(Exception, match="FileNotFoundError"):
        tree.readable(lost).collect()
