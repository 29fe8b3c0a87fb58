import re
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from dictspark.llm.common import _STRETCH, alnum_words, discard, held, map_arrow, map_batches, pieces, shared_folder, space_words, stored, word_hashes
from tests.llm.helpers import rng


def test_equal_words_have_equal_hashes():
    r, seen = rng(1), {}
    texts = ["".join(r.choice("aBz9é \x1c中 \t\n\x0b\x0c\r") for _ in range(r.randint(0, 90))) for _ in range(400)]
    texts += [None, "", " ", "q" * (3 * _STRETCH) + " x", "a B " * _STRETCH, ("w" * 40_000 + " ") * 5, "a" * _STRETCH + " " + "b" * _STRETCH]
    for t in texts:
        words, hashes = space_words(t), word_hashes(t).tolist()
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_short_words_do_not_collide():
    words = [a + b + c for a in "abcdefghij0123456789é" for b in ["", *"abcxyz"] for c in ["", *"abcxyz"]]
    distinct = set(words)
    assert len(set(word_hashes(" ".join(words)).tolist())) == len(distinct)


def test_words():
    assert space_words("A b\x1cC d") == ["a b\x1cc".encode(), b"d"]
    assert alnum_words("Don't É_x-1") == [b"don", b"t", "É".encode(), b"x", b"1"]


def test_pieces_are_the_batch():
    batch = pa.RecordBatch.from_pydict({"x": ["a" * n for n in range(100)]})
    for most in (1, 50, 1_000, 10**9):
        own = list(pieces(batch, most))
        assert pa.Table.from_batches(own).equals(pa.Table.from_batches([batch]))
    assert list(pieces(batch.slice(0, 0), 10)) == []


def test_map_and_store(spark):
    df = spark.range(1_000).selectExpr("id", "repeat('x', cast(id % 50 as int)) AS t")
    out = map_batches(df, lambda b: b.select(["id"]) if b.num_rows else None, "id long", piece_bytes=500)
    kept = stored(out, "test")
    assert sorted(r["id"] for r in kept.collect()) == list(range(1_000))
    folder = shared_folder(spark).rstrip("/").rpartition("/")[2]
    assert kept.inputFiles() and all(folder in p for p in kept.inputFiles())


def test_discarded_tables_are_gone(spark):
    first = stored(spark.range(10).toDF("x"), "test")
    second = stored(first.where("x > 4"), "test")
    discard(first)
    assert second.count() == 5
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(first._stored_at)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_workers_give_back_what_they_freed():
    """A last small array that stays, as caches do, keeps malloc from giving back what lies below it by itself."""
    kept, conf = [], SimpleNamespace(get=lambda *_: "1", set=lambda *_: None)

    def run(batches):
        for batch in batches:
            held = [np.ones(12_000) for _ in range(2_000)]  # 192 MB
            kept.append(held[-1])
            del held
            yield batch

    taken = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1])
    rows = pa.RecordBatch.from_pydict({"x": [1]})
    worker = map_arrow(SimpleNamespace(sparkSession=SimpleNamespace(conf=conf), mapInArrow=lambda f, _: f), run, "x long")
    before = taken()
    assert list(worker(iter([rows]))) == [rows]
    assert taken() - before < 50_000


def test_stored_tables_have_one_file_a_task(spark):
    """None with checksums beside it, for each of which Hadoop's local file system starts a process."""
    out = stored(spark.range(10).repartition(2).toDF("x"), "test")
    names = [p.name for p in Path(out._stored_at.removeprefix("file:")).iterdir()]
    assert sorted(r["x"] for r in out.collect()) == list(range(10))
    assert sum(n.endswith(".parquet") for n in names) == 2 and not [n for n in names if n.endswith(".crc")]
    discard(out)


def test_small_tables_have_few_files(spark):
    out = stored(spark.range(1_000).repartition(8).toDF("x"), "test", rows_a_file=500)
    names = [p.name for p in Path(out._stored_at.removeprefix("file:")).iterdir()]
    assert sorted(r["x"] for r in out.collect()) == list(range(1_000))
    assert sum(n.endswith(".parquet") for n in names) == 2
    discard(out)
    empty = stored(spark.range(0).toDF("x"), "test", rows_a_file=500)
    assert empty.isEmpty()
    discard(empty)


def test_held_tables_are_computed_once(spark):
    counted = spark.sparkContext.accumulator(0)

    def run(batch):
        counted.add(batch.num_rows)
        return batch

    first = held(map_batches(spark.range(100).repartition(8), run, "id long"))
    second = held(first.where("id >= 50"))
    assert (first._rows, second._rows, counted.value) == (100, 50, 100)
    assert first.alias("a").join(first.alias("b"), F.expr("a.id = b.id + 1")).count() == 99 and counted.value == 100
    discard(first)
    assert not first.is_cached and sorted(r["id"] for r in second.collect()) == list(range(50, 100)) and counted.value == 100
    discard(second)
