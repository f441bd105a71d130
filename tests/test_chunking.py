import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import assemble, chunking

SAMPLE = """# Guide

intro line
second line

## Setup #

```python
# not a heading

x = 1
```

- one
  more

- two
after

| a | b |
|---|:-:|
| 1 | 2 |

| single |
|---|

### Deep
~~~
``` inside
# no
~~~
text
# still paragraph
## Next
```
open fence
# x
"""


def docs(spark, *texts):
    return spark.createDataFrame([(f"h{i}", f"p{i}.md", t) for i, t in enumerate(texts)], "file_hash string, file_path string, text string")


def test_blocks(spark):
    rows = chunking.scan_blocks(docs(spark, SAMPLE)).orderBy("pos").collect()
    for r in rows:
        assert SAMPLE[r.char_start : r.char_end] == r.text
    kinds = [(r.kind, r.text.splitlines()[0]) for r in rows]
    assert ("code", "```python") in kinds and ("table", "| a | b |") in kinds and ("paragraph", "| single |") in kinds
    assert ("list", "- one") in kinds and ("code", "~~~") in kinds
    # a heading line right after a paragraph line belongs to the paragraph
    assert ("paragraph", "text") in kinds and ("heading", "## Next") not in kinds


def test_headings_ignore_fences_and_strip_closing_marks(spark):
    rows = chunking.scan_headings(docs(spark, SAMPLE)).orderBy("pos").collect()
    assert [(r.level, r.title) for r in rows] == [(1, "Guide"), (2, "Setup"), (3, "Deep"), (1, "still paragraph"), (2, "Next")]
    for r in rows:
        assert SAMPLE[r.char_start : r.char_end].lstrip("#").strip(" #") == r.title


def test_heading_path_pops_levels(spark):
    md = "# A\n\n### C\n\n## B\n\nx\n\n# D\n\n## E"
    rows = chunking.heading_path(chunking.scan_headings(docs(spark, md))).orderBy("pos").collect()
    assert [r.heading_path for r in rows] == [["A"], ["A", "C"], ["A", "B"], ["D"], ["D", "E"]]


def naive_overlapping(counts, limit):
    out, buf = [], []
    for i, n in enumerate(counts):
        if n == 0:
            continue
        if n > limit:
            if buf:
                out.append((buf[0], buf[-1], False))
            buf = []
            out.append((i, i, True))
        elif sum(counts[j] for j in buf) + n <= limit:
            buf.append(i)
        else:
            if buf:
                out.append((buf[0], buf[-1], False))
                buf = [buf[-1]]
            buf.append(i)
    if buf:
        out.append((buf[0], buf[-1], False))
    return out


def test_folds_equal_a_plain_loop():
    rng = random.Random(3)
    for _ in range(2000):
        counts = [rng.randrange(0, 12) for _ in range(rng.randrange(0, 15))]
        assert chunking.overlapping_groups(counts, 9) == naive_overlapping(counts, 9)


@pytest.mark.parametrize("partitions", [1, 8])
def test_chunks_keep_offsets_and_dense_ids(spark, partitions):
    rng = random.Random(5)
    words = ["alpha", "beta.", "gamma", "深度", "delta!", "eps\n", "\n\n", "## h\n", "- item\n", "x" * 30]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 400))) for _ in range(20)] + [SAMPLE, "", " \n ", "word " * 300]
    out = chunking.chunk_documents(docs(spark, *texts).repartition(partitions), chunking.ChunkerConfig(20, 100)).collect()
    by_doc = {}
    for r in out:
        by_doc.setdefault(r.file_hash, []).append(r)
        source = texts[int(r.file_hash[1:])]
        assert r.content == source[r.char_start : r.char_end].strip() and r.content
        assert r.token_count <= 40
    assert "h21" not in by_doc and "h22" not in by_doc
    for h, rows in by_doc.items():
        rows.sort(key=lambda r: r.chunk_index)
        assert [r.chunk_id for r in rows] == [f"{h}:{i}" for i in range(len(rows))]
        assert [r.char_start for r in rows] == sorted(r.char_start for r in rows)
        covered = set()
        for r in rows:
            covered.update(range(r.char_start, r.char_end))
        source = texts[int(h[1:])]
        assert all(i in covered for i, c in enumerate(source) if not c.isspace())


def test_hard_windows_overlap_is_clamped_to_a_quarter(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(text,)], "s string")
    rows = chunking.hard_split(df, "s", 8, 100).orderBy("window").collect()
    pieces = [r.piece.split() for r in rows]
    assert all(len(p) <= 8 for p in pieces) and pieces[0][-2:] == pieces[1][:2]
    assert pieces[-1][-1] == "w49" and [text[r.rel_start : r.rel_end] for r in rows] == [r.piece for r in rows]


def test_locators_follow_the_sections(spark):
    pages = spark.createDataFrame([("d", 1, "first page"), ("d", 2, "  "), ("d", 3, "third")], "doc string, n int, body string")
    pieces = assemble.assemble_sections(pages, "doc", "n", F.concat(F.lit("Page "), F.col("n").cast("string")), F.col("body"))
    joined = assemble.assemble_documents(pieces, "doc", ["n"]).withColumnRenamed("doc", "file_hash").withColumn("file_path", F.lit("x.pdf"))
    assert joined.first().text == "## Page 1\n\nfirst page\n\n## Page 3\n\nthird\n\n"
    chunks = chunking.chunk_documents(joined, locator_map=pieces.withColumnRenamed("doc", "file_hash")).orderBy("chunk_index").collect()
    assert [(c.heading_text, c.locator.page_from) for c in chunks] == [("Page 1", 1), ("Page 3", 3)]


def test_oversize_documents_keep_their_pieces(spark):
    pages = spark.createDataFrame([("d", i, "x" * 50) for i in range(5)], "doc string, n int, body string")
    pieces = assemble.assemble_sections(pages, "doc", "n", F.lit("t"), F.col("body"), hot_rows=2)
    row = assemble.assemble_documents(pieces, "doc", ["n"], max_text=100).first()
    assert row.text is None and row.total_chars == 5 * len("## t\n\n" + "x" * 50 + "\n\n") and pieces.count() == 5


def test_html(spark):
    html = "<html><head><style>p{}</style></head><body><h2>T <b>x</b></h2><p>a<br>b</p><table><tr><th>h|1</th></tr><tr><td>1</td><td>2</td></tr></table><script>var a='<p>'</script></body></html>"
    assert assemble.markdown_of(html) == "## T **x**\n\na\nb\n\n| h\\|1 |  |\n| --- | --- |\n| 1 | 2 |\n"


def test_trim_knows_all_spaces(spark):
    assert spark.range(1).select(T.trim_ws(F.lit("　\t a b ﻿\n")).alias("t")).first().t == "a b"


def test_a_file_may_give_any_number_of_chunks(spark):
    text = "\n\n".join(f"# h{i}\n\nbody" for i in range(10_500))
    files = spark.createDataFrame([("h", "a.md", text)], "file_hash string, file_path string, text string")
    assert chunking.chunk_documents(files).count() == 10_500


def test_slides_with_a_title_only_are_kept(spark):
    rows = [("d", 1, "T", "", False), ("d", 2, "U", "b", False), ("d", 3, "N", " ", True)]
    df = spark.createDataFrame(rows, "doc string, n int, title string, body string, is_note boolean")
    out = assemble.assemble_sections(df, "doc", "n", F.col("title"), F.col("body"), kind="slide").orderBy("n").collect()
    assert [r.piece for r in out] == ["## T\n\n", "## U\n\nb\n\n"]
    assert [r.n for r in assemble.assemble_sections(df, "doc", "n", F.col("title"), F.col("body")).collect()] == [2]
