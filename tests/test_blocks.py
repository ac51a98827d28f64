"""CSV files cut into blocks, against the csv module."""

import csv
import hashlib
import io
import random

import pytest

from tabscope.functions.values import ORDINAL
from tabscope.plans import catalogue
from tabscope.sources import blocks
from tabscope.sources.reader import HEAD, SNIFFED, decoded, read_dataset

SIZES = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"


@pytest.fixture
def small_blocks(spark):
    before = {s: spark.conf.get(s, None) for s in SIZES}
    yield lambda n: [spark.conf.set(s, v) for s, v in zip(SIZES, (f"{n}b", "1b", "1"), strict=True)]
    for s, v in before.items():
        spark.conf.unset(s) if v is None else spark.conf.set(s, v)


def drawn(seed, n, end):
    rng = random.Random(seed)
    cell = lambda: rng.choice(["", "x", "two words", 'say ""hi""', "5", "é", "a,b", "l1\nl2", "\n", "\r\n", 'q"q', "long " * rng.randint(1, 60), "\n\n\n" * rng.randint(1, 9)])
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow(["a", "b", "c"])
    for _ in range(n):
        w.writerow([cell() for _ in range(rng.randint(1, 3))])
        if rng.random() < 0.1:
            out.write(end)
        if rng.random() < 0.1:
            out.write(f'un"quoted,5" pipe,"odd"tail{end}')
    return out.getvalue()


def parsed(text):
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=",") if r]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [64, 700, 10**6])
def test_records(spark, tmp_path, small_blocks, seed, end, size):
    text = drawn(seed, 120, end)
    file = tmp_path / "t.csv"
    file.write_bytes(text.encode())
    small_blocks(size)
    found = blocks.records(spark, str(file), ",", "UTF-8")
    assert [r["fields"] for r in sorted(found.collect(), key=lambda r: r[ORDINAL])] == parsed(text)
    if size == 700:
        assert blocks.lines_of(spark, str(file), "UTF-8").rdd.getNumPartitions() > 5


def test_ends_inside():
    for line, inside, end in [
        ('a,"b', False, True), ('a,"b"', False, False), ('a"b,c', False, False), ('b",c', True, False), ('b"",c', True, True),
        ('b",""', True, False), ('b","', True, True), ("", True, True), ("", False, False), ('"""', False, True), ('"a"b"c,d', False, False),
    ]:
        assert blocks.ends_inside(line, inside, ",") is end, line


def test_dataset(spark, tmp_path, small_blocks):
    file = tmp_path / "t.csv"
    file.write_bytes('﻿key;note;size\n1;"one\ntwo";1,5\n2;NA;2,25\n\n3;"x;y"\n'.encode())
    small_blocks(16)
    rows = sorted(map(tuple, read_dataset(spark, str(file)).collect()))
    assert rows == [(1, "one\ntwo", 1.5), (2, None, 2.25), (3, "x;y", None)]
    latin = tmp_path / "l.csv"
    latin.write_bytes('a,b\n"caf\xe9\nnoir",1\n'.encode("latin-1"))
    assert [tuple(r) for r in read_dataset(spark, str(latin)).collect()] == [("caf\xe9\nnoir", 1)]


def test_too_many_fields(spark, tmp_path):
    file = tmp_path / "t.csv"
    file.write_bytes(b'a,b\n"1\n2",3\n4,5,6\n')
    with pytest.raises(Exception, match="Unable to read"):
        read_dataset(spark, str(file))


@pytest.mark.parametrize("size", [16, 10**6])
def test_folder(spark, tmp_path, small_blocks, size):
    """Files with a header each, an empty one and one that ends within quotes among them, are one table."""
    folder = tmp_path / "t"
    folder.mkdir()
    texts = ['id,note\n1,"one\ntwo"\n2,"a ""b""\n\nc"\n', 'id,note\n3,plain\n', "", "id,note\n", 'id,note\n4,"never\nclosed', '\n\nid,note\n5,"x\n' + "y\n" * 30 + '"\n6,z\n']
    for k, text in enumerate(texts):
        (folder / f"part-{k}.csv").write_text(text)
    small_blocks(size)
    rows = sorted(map(tuple, read_dataset(spark, str(folder), "t.csv").collect()))
    assert rows == [(1, "one\ntwo"), (2, 'a "b"\n\nc'), (3, "plain"), (4, "never\nclosed"), (5, "x\n" + "y\n" * 30), (6, "z")]


def test_queries_write_files_by_many_tasks(spark, tables):
    folder = catalogue.written_csv(spark.range(1000).repartition(5))
    assert spark.read.format("binaryFile").load(folder).count() == 5
    assert sorted(r[0] for r in read_dataset(spark, folder, "t.csv").collect()) == list(range(1000))


def test_head_ends_within_a_character():
    for letter in "é€𝔘":
        for before in range(1, len(letter.encode())):
            text = "x" * (SNIFFED - before) + letter
            assert decoded((text + letter * 9).encode()[:HEAD]) == (text, "UTF-8")
    for letter in "é\xa0":  # Latin-1 all the same, at the end or whole
        text = "x" * (SNIFFED - 1) + letter
        assert decoded((text + "yyy").encode("latin-1")) == (text, "ISO-8859-1")
        assert decoded(letter.encode("latin-1")) == (letter, "ISO-8859-1")


@pytest.mark.parametrize("breaks", [True, False])
def test_dataset_with_a_head_that_ends_within_a_character(spark, tmp_path, breaks):
    notes = ["é" * 20_000 + "\n" * breaks, "x" * breaks + "é" * 30_000, "naïve\n" if breaks else "naïve"]
    data = ("id,note\n" + "".join(f'{k},"{n}"\n' for k, n in enumerate(notes))).encode()
    data = data.replace(b"id,", b"id," if data[SNIFFED] & 0xC0 == 0x80 else b"key,")
    assert data[SNIFFED] & 0xC0 == 0x80
    file = tmp_path / "t.csv"
    file.write_bytes(data)
    for source in (str(file), data):
        assert [r["note"] for r in read_dataset(spark, source, "t.csv").collect()] == notes


def test_line_breaks_of_odd_texts(spark, tmp_path):
    """Empty texts and the likes of NA stay, others are read as they are though the sniffed bytes end within a character."""
    texts = ["", "NA", "null", None, " x ", "5", "a", '"', "a\r\nb\r", "\n"]
    for lang, long in [(None, None), ("fr", "é" * 40_000), ("fr", "xé" + "é" * 40_000)]:
        rows = [(0, long, lang), *((k + 1, t, "NA" if k % 2 else "en") for k, t in enumerate(texts))]
        folder = tmp_path / f"t{len(long or '')}"
        spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
        digest = lambda t: t if t is None else hashlib.sha256(t.replace("a", '\n"').encode()).hexdigest()
        found = catalogue.QUERIES["read_csv_line_breaks"](spark, str(folder))
        assert sorted(map(tuple, found.collect())) == [(k, digest(t), None if x == "en" else x) for k, t, x in rows]
