import pytest
from pyspark.sql import functions as F

from lectern.functions import scope, text
from lectern.operators import diff

GLOBS = [
    ("a.md", "a.md", True), ("dir/x.tmp", "*.tmp", True), ("notes/a/b.md", "notes/*", True), ("a/b/c.md", "a/*/c.md", True),
    ("a/b/d/c.md", "a/*/c.md", False), ("templates/x.md", "templates/**/x.md", True), ("templates/a/b/x.md", "templates/**/x.md", True),
    ("a/b/c", "**", True), ("a+b.md", "**a+b.md", True), ("aab.md", "a+b*.md", False), ("x/y.md", "", False), ("x", "*", True), ("x/y", "*", False),
]


def test_globs(spark):
    for path, pattern, want in GLOBS:
        got = spark.range(1).select(scope.glob_match(F.lit(path), pattern).alias("m")).first().m
        assert got is want, (path, pattern)


@pytest.mark.parametrize("path,source,want", [
    ("notes/a.md", scope.Source("s", "notes"), True),
    ("notes2/a.md", scope.Source("s", "notes"), False),
    ("notes/sub/a.md", scope.Source("s", "notes", recursive=False), False),
    ("notes/.git/a.md", scope.Source("s", "notes"), False),
    ("notes/.git/a.md", scope.Source("s", "notes", exclude_globs=()), True),
    ("notes/a.md", scope.Source("s", "notes", enabled=False), False),
    ("a.md", scope.Source("s", "", recursive=False), True),
    ("b/a.md", scope.Source("s", "", recursive=False), False),
])
def test_in_source(spark, path, source, want):
    assert spark.range(1).select(scope.in_source(F.lit(path), source).alias("m")).first().m is want


OLD = "file_path string, file_hash string, source_mtime long, file_size long, is_current boolean"
NEW = "file_path string, file_hash string, source_mtime long, file_size long"


def run_diff(spark, old, new, **kw):
    rows = diff.diff_snapshots(spark.createDataFrame(old, OLD), spark.createDataFrame(new, NEW), **kw).collect()
    return {(r.classification, r.old_path, r.file_path) for r in rows}


def test_every_class(spark):
    old = [("same", "h1", 1, 5, True), ("stale", "h2", 1, 5, False), ("touch", "h3", 1, 5, True), ("edit", "h4", 1, 5, True), ("gone", "h5", 1, 5, True), ("from", "h6", 1, 5, True), ("nosize", "h8", 1, None, True), ("size", "h9", 1, 4, True)]
    new = [("same", "h1", 1, 5), ("stale", "h2", 1, 5), ("touch", "h3", 2, 5), ("edit", "x", 2, 6), ("to", "h6", 9, 5), ("fresh", "h7", 1, 1), ("nosize", "h8", 1, 7), ("size", "z", 1, 5)]
    assert run_diff(spark, old, new) == {
        ("UNCHANGED", None, "same"), ("STALE_PARSER", None, "stale"), ("MTIME_ONLY", None, "touch"), ("CONTENT_CHANGED", None, "edit"),
        ("DELETED", None, "gone"), ("RENAMED", "from", "to"), ("NEW_PATH", None, "fresh"), ("UNCHANGED", None, "nosize"), ("CONTENT_CHANGED", None, "size"),
    }


def test_renames_pair_in_dictionary_order_even_for_a_hot_hash(spark):
    n = 300
    old = [(f"x{i:03}", "h", 1, 1, True) for i in range(n)]
    new = [(f"a{i:03}", "h", 1, 1) for i in range(n + 2)]
    got = run_diff(spark, old, new, hot_rows=20)
    want = {("RENAMED", f"x{i:03}", f"a{i:03}") for i in range(n)} | {("NEW_PATH", None, f"a{n:03}"), ("NEW_PATH", None, f"a{n + 1:03}")}
    assert got == want


def test_latest_revives_after_tombstone(spark):
    log = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, False), ("b", 2, True), ("b", 3, False)], "p string, seq int, tombstone boolean")
    assert [(r.p, r.seq) for r in diff.latest(log, "p").collect()] == [("b", 3)]


def test_version_key_depends_on_every_part(spark):
    def key(version, opts, parser=2):
        return spark.range(1).select(text.version_key(F.lit(version), F.lit(opts), parser).alias("k")).first().k

    keys = [key(1, ""), key(2, ""), key(1, "notes"), key(1, "", 3)]
    assert len(set(keys)) == 4 and keys[0] == key(1, "") and all(0 <= k < 2**32 for k in keys)


def test_tokens_keep_punctuation_and_split_han(spark):
    got = spark.range(1).select(text.tokens(F.lit("深度 learning, été 3.　x")).alias("t")).first().t
    assert got == ["深", "度", "learning", ",", "été", "3", ".", "x"]
