"""The file source: every kind of file, what is damaged, partitions, suffixes that are left unopened; pages cleaned by hand."""

import re
from collections import Counter

from pyspark.sql import functions as F

from loomgraph.plans import q_source
from loomgraph.sources import file_source as S
from loomgraph.sources import readers

SMALL = "/root/testdata/sf0.001"


def pages(data):
    return data.decode("utf-8").split("\f")


def folder(tmp_path):
    (tmp_path / "sub.d").mkdir()
    files = {
        "a.md": b" # Title\n\ntext \n", "sub.d/b.MD": "Zürich".encode(), "blank.md": b" \n", "bad.md": b"\xff\xfe", "w.docx": S.docx_of(["one", " ", "two & <three>"], [["a ", "b"], ["", ""]]),
        "cut.docx": S.docx_of(["x"])[:40], "none.docx": b"", "p.pdf": "first page.\fsecond page.".encode(), "empty.pdf": b"\f\f", "note.txt": b"x", "noext": b"y", "_SUCCESS": b"", ".hidden.md": b"z",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def test_files_of_every_kind(spark, tmp_path):
    rows = S.read_files(spark, folder(tmp_path), pages, partition_files=3).collect()
    got = {(r.title, r.suffix): (r.mime_type, r.text, r.error) for r in rows}
    md, word, pdf = readers.MIME["md"], readers.MIME["docx"], readers.MIME["pdf"]
    assert len(rows) == 11 and got == {
        ("a", "md"): (md, "# Title\n\ntext", None), ("b", "md"): (md, "Zürich", None), ("blank", "md"): (md, None, "blank"), ("bad", "md"): (md, None, "damaged: UnicodeDecodeError"),
        ("w", "docx"): (word, "one\ntwo & <three>\na | b\n |", None), ("cut", "docx"): (word, None, "damaged: BadZipFile"), ("none", "docx"): (word, None, "damaged: BadZipFile"),
        ("p", "pdf"): (pdf, "first page.\n\nsecond page.", None), ("empty", "pdf"): (pdf, None, "blank"), ("note", "txt"): (None, None, "unsupported suffix: txt"), ("noext", ""): (None, None, "unsupported suffix: "),
    }
    assert {r.error for r in S.read_files(spark, str(tmp_path)).where("suffix = 'pdf'").collect()} == {"unsupported suffix: pdf"}


def test_partitions_and_suffixes(spark, tmp_path):
    path = folder(tmp_path)
    reader = S.FileReader({"path": path, "partition_files": "4"}, None)
    assert [len(p.paths) for p in reader.partitions()] == [4, 4, 3]
    small = S.FileReader({"path": path, "partition_bytes": "1"}, None)
    assert max(len(p.paths) for p in small.partitions()) <= 2
    assert [len(S.FileReader({"path": path, **o}, None).partitions()[0].paths) for o in ({"only": "md"}, {"but": "md,pdf"}, {"only": "xyz"})] == [4, 5, 0]
    spark.dataSource.register(S.file_source())
    assert {r.title for r in spark.read.format(S.NAME).option("only", "md").load(path).collect()} == {"a", "b", "blank", "bad"}


def plain_page_texts(pages):
    """Pages to a text, line by line."""
    key = lambda x: re.sub(r"\s+", " ", re.sub(r"\b\d+\b", " ", re.sub(r"\bpage\s+\d+(?:\s+of\s+\d+)?\b", " ", x.lower()))).strip()
    number, own_form, closed, back = (re.compile(p) for p in (readers.PAGE_NUMBER, readers.OWN_FORM, readers.CLOSED, readers.BACKMATTER))
    lines = [[x.strip(" ") for x in p.replace("\r", "\n").split("\n") if x.strip(" ")] for p in pages]
    seen = Counter()
    if len(pages) >= 3:
        for ls in lines:
            likely = [x for x in ls if len(x) <= 160 and (number.search(x) or key(x))]
            seen.update({key(x) for x in likely[:2] + likely[-2:]} - {""})
    margins = {k for k, n in seen.items() if n >= max(3, len(pages) // 2)}
    own = lambda x: bool(own_form.search(x)) or x.upper() == x and x.lower() != x and len(x) <= 120
    blocks = []
    for ls in lines:
        page = []
        for x in ls:
            if key(x) in margins or number.search(x):
                continue
            if page and page[-1].endswith("-") and x[0].islower():
                page[-1] = page[-1][:-1] + x
            elif not page or own(page[-1]) or own(x) or closed.search(page[-1]):
                page.append(x)
            else:
                page[-1] += " " + x
        blocks += page
    if len(blocks) >= 24:
        first = max(8, int(len(blocks) * 0.35))
        blocks = blocks[: next((i for i in range(first, len(blocks)) if back.search(blocks[i])), len(blocks))]
    return "\n\n".join(blocks)


def test_page_texts_by_hand(spark):
    rows = q_source.paged(spark, SMALL)
    extra = [(-1, ["Head 1\nfirst hyphen-\nated line\n1", "Head 2\n- item\nnext\n2", "Head 3\nEND\nof it.\nReferences\n3"]), (-2, [f"p {k}.\n\nBlock {k} ends." + ("\nReferences\n[1] x" if k == 20 else "") for k in range(30)]), (-3, ["", " \n "])]
    df = rows.unionByName(spark.createDataFrame(extra, rows.schema))
    got = {r.id: r.text for r in readers.page_texts(df).collect()}
    want = {r.id: plain_page_texts(r.pages) for r in df.collect()}
    assert got == {k: v for k, v in want.items() if v}
    assert -3 not in got and "hyphenated line" in got[-1] and "Head" not in got[-1]


def test_embedding_failures_are_rows(spark):
    from loomgraph.operators import vectors

    def model(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("refused")
        return [[float(len(t)), 0.0] for t in texts]

    df = spark.createDataFrame([(1, "ab"), (2, "bad"), (3, "c")], "id long, text string").coalesce(1)
    got = {r.id: (r.embedding, r.error) for r in vectors.embed(df, model, 2, keep_errors=True).collect()}
    assert got == {1: ([1.0, 0.0], None), 2: (None, "RuntimeError: refused"), 3: ([1.0, 0.0], None)}
    assert {r.id for r in vectors.embed(df.where("id <> 2"), model, 2).select("id", F.col("embedding")).collect()} == {1, 3}
