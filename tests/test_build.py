import os
import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from dictspark.cli import main
from dictspark import storage
from dictspark.functions import arrow, misc
from dictspark.functions.strings import characters, is_ascii, parse_uint64, split_fields, trimmed, utf8_lengths
from dictspark.operators.batch import fuzzy_join, lookup, members, strangers
from dictspark.operators.dictionary import Dictionary, build_set, map_from_lines, refused, set_from_lines
from dictspark.operators import graph
from dictspark.operators.graph import dot_lines, dot_table, graph_stats, path_sums, transducer
from dictspark.operators.linesort import place_lines, sort_lines
from dictspark.operators.query import result_lines, scan
from dictspark.sources.text import line_count, line_report, read_lines
from dictspark.storage import exists, make_folder, remove, shared_folder
from dictspark.streaming.enrich import enriched

SAMPLE = [("", 10000), ("中国", 100), ("中国人", 50), ("中国人民", 40), ("中国心", 10), ("北七", 3), ("北七家", 10), ("北京", 5), ("北平", 2)]


def lines(spark, *texts):
    return spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "line string, line_no long")


def pairs(d):
    return {r["key"]: int(r["value"]) for r in d.df.collect()}


def test_map_lines(spark):
    rows = lines(spark, "a,9", "a,10", "b,1,x,y", "nothing", "", ",10000", " c,3\r", "d,")
    assert pairs(map_from_lines(rows)) == {"a": 9, "b": 1, "": 10000, " c": 3, "d": 0}
    assert pairs(map_from_lines(rows, presorted=True)) == {"a": 10, "b": 1, "": 10000, " c": 3, "d": 0}
    assert {r["key"] for r in set_from_lines(rows).df.collect()} == {"a", "b", "nothing", "", " c", "d"}
    assert line_report(rows).first().asDict() == {"n_lines": 8, "n_empty": 1, "n_short": 1, "n_map": 6, "n_set": 7}


def strict_model(texts, presorted):
    """Keys in the order of insertion against the greatest one taken so far."""
    rows = list(enumerate(texts)) if presorted else sorted(enumerate(texts), key=lambda x: (x[1].strip(" \t\r\n").encode(), x[0]))
    top, out = None, {}
    for _, t in rows:
        if not t or t.count(",") < 1:
            continue
        key, value = t.split(",")[:2]
        k = key.encode()
        if top is not None and k < top and (not top.startswith(k) or not k):
            continue
        out[key] = int(value)
        top = k if top is None else max(top, k)
    return out


@pytest.mark.parametrize("presorted", [False, True])
def test_strict_builds_leave_out_what_is_out_of_order(spark, presorted):
    rng = random.Random(11)
    for _ in range(3):
        texts = ["".join(rng.choice(" ab中") for _ in range(rng.randint(0, 3))) + f",{rng.randint(0, 99)}" for _ in range(80)]
        rows = lines(spark, *texts)
        assert pairs(map_from_lines(rows, presorted, strict=True)) == strict_model(texts, presorted)
        assert {r["key"] for r in set_from_lines(rows, presorted, strict=True).df.collect()} == set(strict_model(texts, presorted))


def test_word_counts(spark, monkeypatch):
    """The words of odd texts, and no row for each occurrence: one for each word and part."""
    monkeypatch.setattr(arrow, "STRETCH", 50)
    rng = random.Random(5)
    marks = [" ", "\n", "-", "\x00", "\x1c", "\x7f", "@", "`", "{", "/", ":", "_"]
    texts = ["".join(rng.choice(["The", "x1", "É", "é", "İ", "ſ", "中", "\u0085", "\u2028", "\U0001f600", *marks]) for _ in range(rng.randint(0, 200))) for _ in range(200)]
    texts += [None, "", " ", "w " * 20_000, "long" * 500 + " end"]
    want = Counter(w for t in texts for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    for most in (10, 1 << 18):
        rows = arrow.word_counts(docs, "text", most).collect()
        got = Counter()
        for r in rows:
            got[r["key"]] += r["n"]
        assert got == want
    assert len(rows) <= 3 * len(want)
    assert arrow.word_counts(docs.limit(0)).collect() == []
    broken = spark.range(1).select(F.expr("CAST(x'4120C32078' AS STRING)").alias("text"))
    assert sorted(map(tuple, arrow.word_counts(broken).collect())) == [("a", 1), ("x", 1), ("\ufffd", 1)]


def test_one_row_group_is_dealt_out(spark, tmp_path, monkeypatch):
    """All rows once, in as many tasks as there are cores; tables that are small or have as many files stay as they are."""
    rows = spark.range(1000).select(F.col("id").cast("string").alias("text"))
    rows.coalesce(1).write.parquet(str(tmp_path / "a table"))
    rows.repartition(8).write.parquet(str(tmp_path / "many"))
    one, many = (spark.read.parquet(str(tmp_path / name)) for name in ("a table", "many"))
    assert storage.spread(one) is one
    monkeypatch.setattr(storage, "DEALT", 1 << 10)
    dealt = storage.spread(one)
    sizes = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(r[1] for r in sizes) < 500
    assert sorted(r[0] for r in dealt.collect()) == sorted(map(str, range(1000)))
    assert storage.spread(many) is many


def test_workers_need_not_find_the_package(tmp_path):
    code = f"""import sys
sys.path.insert(0, {str(Path(__file__).parents[1])!r})
from pyspark.sql import SparkSession
from dictspark.functions.arrow import word_counts
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
print(word_counts(spark.createDataFrame([("a b a",)], "text string")).agg({{"n": "sum"}}).first()[0])"""
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}).stdout.split()[-1] == "3"


def test_refused_rows(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(["b", "bc", "a", "b", "", "c"])], "key string, line_no long")
    assert [r["line_no"] for r in refused(rows, F.struct("line_no")).where("refused").orderBy("line_no").collect()] == [2, 4]


@pytest.mark.parametrize(
    "text, value",
    [("10abc", 10), ("3.7", 3), (" \t42", 42), ("x", 0), ("", 0), (None, 0), ("+7", 7), ("-1", 2**64 - 1), ("-0", 0), ("18446744073709551615", 2**64 - 1), ("18446744073709551616", 2**64 - 1), ("9" * 40, 2**64 - 1), ("0" * 40 + "5", 5), ("-18446744073709551616", 2**64 - 1), ("99999999999999999999", 2**64 - 1)],
)
def test_uint64(spark, text, value):
    assert int(spark.createDataFrame([(text,)], "t string").select(parse_uint64(F.col("t"))).first()[0]) == value


def test_strings(spark):
    row = spark.createDataFrame([(" \ta中é \r\n", "a,,b,")], "x string, y string").select(
        trimmed(F.col("x")), characters(trimmed(F.col("x"))), utf8_lengths(trimmed(F.col("x"))), is_ascii(F.col("x")), split_fields(F.col("y"), ","), split_fields(F.col("y"), ",", True)
    ).first()
    assert list(row) == ["a中é", ["a", "中", "é"], [1, 3, 2], False, ["a", "", "b", ""], ["a", "b"]]


def test_reading_keeps_line_ends(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"a\r\n\nb \nc")
    rows = read_lines(spark, str(tmp_path / "f")).orderBy("line_no").collect()
    assert [r["line"] for r in rows] == ["a\r", "", "b ", "c"]


def model_of_sort(texts, keep):
    own = [t for t in texts if keep or t.strip(" \t\r\n")]
    return sorted(own, key=lambda t: t.strip(" \t\r\n").encode())


def test_sort_is_stable(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \t中") for _ in range(rng.randint(0, 4))) for _ in range(500)]
    for keep in (True, False):
        assert [r["line"] for r in sort_lines(lines(spark, *texts), keep).collect()] == model_of_sort(texts, keep)
        placed = sorted((r["place"], r["line"]) for r in place_lines(lines(spark, *texts), keep, line_col="line").collect())
        assert placed == list(enumerate(model_of_sort(texts, keep), 1))


@pytest.mark.parametrize("keep", [True, False])
def test_sorting_files(spark, tmp_path, keep):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \t\r中é") for _ in range(rng.randint(0, 5))) for _ in range(300)]
    (tmp_path / "in").write_bytes("\n".join([*texts, ""]).encode())
    assert main(["sort", "-f", str(tmp_path / "in"), "-o", str(tmp_path / "out"), *([] if keep else ["-i"])], spark) == 0
    own = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert own.decode().split("\n")[:-1] == model_of_sort(texts, keep)
    with pytest.raises(AnalysisException):  # the folder exists by now
        main(["sort", "-f", str(tmp_path / "in"), "-o", str(tmp_path / "out")], spark)


def test_fuzzy_from_the_command_line(spark, tmp_path, capsys):
    near = ["air", "chair", "hail", "hair", "hairy", "her", "pair", "stair"]
    swapped = ["ahi", "ahis", "lari", "liar", "sari", "zari"]  # Levenshtein distance 3 from hair, restricted Damerau 2
    far = ["house", "ahria", ""]
    build_set(spark.createDataFrame([(w,) for w in near + swapped + far], "key string")).save(str(tmp_path / "d"))
    for extra, wanted in (([], near), (["-m"], near + swapped), (["-l", "2"], ["hail", "hair", "hairy"])):
        assert main(["fuzzy", "-f", str(tmp_path / "d"), "-z", "hair", "-d", "2", *extra], spark) == 0
        assert capsys.readouterr().out.split() == [f"[{w}]" for w in sorted(wanted)]


def model_graph(items, has_values=True):
    """Nodes and edges by the definition: a trie, outputs by least values, equal subtrees shared, numbers by depth-first visits."""
    data = {k.encode(): v if has_values else 0 for k, v in items}
    prefixes = {k[:i] for k in data for i in range(len(k) + 1)}
    acc = {p: 0 if p == b"" else min(v for k, v in data.items() if k.startswith(p)) for p in prefixes}
    kind = {p: tuple(sorted((k[len(p) :], v - acc[p]) for k, v in data.items() if k.startswith(p))) for p in prefixes}
    ids, edges, nodes = {}, set(), {}

    def walk(p):
        if kind[p] in ids:
            return
        ids[kind[p]] = len(ids)
        nodes[ids[kind[p]]] = (p in data, data[p] - acc[p] if p in data else 0)
        for b in sorted({q[-1] for q in prefixes if len(q) == len(p) + 1 and q.startswith(p)}):
            q = p + bytes([b])
            walk(q)
            edges.add((ids[kind[p]], ids[kind[q]], b, acc[q] - acc[p]))

    walk(b"")
    return {(i, *x) for i, x in nodes.items()}, edges


@pytest.mark.parametrize("seed", range(4))
def test_graph(spark, seed):
    rng = random.Random(seed)
    items = SAMPLE if seed == 0 else [(k, rng.randint(0, 9)) for k in {"".join(rng.choice("abé") for _ in range(rng.randint(0, 5))) for _ in range(40)}]
    d = Dictionary(spark.createDataFrame(items, "key string, value long"))
    for has_values, own in ((True, d), (False, Dictionary(d.df.select("key")))):
        g = transducer(own)
        nodes, edges = model_graph(items, has_values)
        assert {tuple(map(int, r)) for r in g.nodes.collect()} == {tuple(map(int, x)) for x in nodes}
        assert {tuple(map(int, r)) for r in g.edges.collect()} == edges
    if seed == 0:
        assert (lambda s: (s["n_nodes"], s["n_edges"]))(graph_stats(transducer(d)).first()) == (26, 29)


def model_dot(items):
    """The drawing by its definition, walked by plain recursion over the model's nodes and edges."""
    nodes, edges = model_graph(items)
    nodes, out, drawn = {i: (final, more) for i, final, more in nodes}, ["digraph fst {", '\t\tlabelloc="l";', '\t\tlabeljust="l";', '\t\trankdir="UD";', ""], set()

    def name(path):
        """Adds the character that the last bytes of the path end, if any, to each of its bytes."""
        for size in range(2, 5):
            tail = path[-size:]
            try:
                c = bytes(b for b, _ in tail).decode()
            except UnicodeDecodeError:
                continue
            if len(tail) == size and len(c) == 1:
                for i, (_, seen) in enumerate(tail):
                    seen.append(f"{c}[{i + 1}]")

    def walk(n, path):
        name(path)
        if n in drawn:
            return
        drawn.add(n)
        final, more = nodes[n]
        out.append(f'\t\t{n}[label="{n}' + (f"/{more}" if more > 0 else "") + '"' + (",peripheries=2" if final else "") + "]")
        for src, dst, byte, more in sorted((e for e in edges if e[0] == n), key=lambda e: e[2]):
            path.append((byte, []))
            walk(dst, path)
            _, seen = path.pop()
            label = chr(byte).replace("\\", "\\\\").replace('"', '\\"') if byte < 128 else f"0x{byte:x}[{','.join(seen)}]"
            out.append(f'\t\t{src} -> {dst} [label="{label}' + (f"/{more}" if more > 0 else "") + '"]')

    walk(0, [])
    return [*out, "}"]


def test_dot(spark):
    for items in (SAMPLE, [("ab", 3), ("b", 1)], [('a"b', 1), ("a\\", 2), ("é", 0), ("éa", 7), ("ê", 7)]):
        assert list(dot_lines(Dictionary(spark.createDataFrame(items, "key string, value long")))) == model_dot(items)
    text = model_dot(SAMPLE)
    assert sum("->" in t for t in text) == 29 and sum("->" not in t and "[label" in t for t in text) == 26
    assert text[5] == '\t\t0[label="0/10000",peripheries=2]' and any("京[1],七[1]" in t or "七[1],京[1]" in t for t in text)
    small = list(dot_lines(Dictionary(spark.createDataFrame([("ab", 3), ("b", 1)], "key string, value long"))))
    assert small[5:] == ['\t\t0[label="0"]', '\t\t1[label="1"]', '\t\t2[label="2",peripheries=2]', '\t\t1 -> 2 [label="b"]', '\t\t0 -> 1 [label="a/3"]', '\t\t0 -> 2 [label="b/1"]', "}"]
    assert list(dot_lines(Dictionary(spark.createDataFrame([], "key string, value long")))) == [*small[:5], "}"]


def test_dot_as_a_table(spark, monkeypatch):
    items = [('a"b', 1), ("a\\", 2), ("b", 5)]
    d = Dictionary(spark.createDataFrame(items, "key string, value long"))
    assert sorted(r["line"] for r in dot_table(transducer(d)).collect()) == sorted(model_dot(items)[5:-1])
    monkeypatch.setattr(graph, "DRAWN", 2)
    with pytest.raises(ValueError):
        list(dot_lines(d))


def test_path_sums_give_the_values_back(spark):
    d = Dictionary(spark.createDataFrame(SAMPLE, "key string, value long"))
    keys = spark.createDataFrame([(k,) for k, _ in SAMPLE] + [("中",), ("北京x",), ("x",)], "key string")
    assert {r["key"]: int(r["value"]) for r in path_sums(transducer(d), keys).collect()} == dict(SAMPLE)
    assert path_sums(transducer(d), keys.limit(0)).collect() == []


def test_storage(spark):
    at = f"{shared_folder(spark)}/some/folder"
    assert not exists(spark, at) and make_folder(spark, at) and exists(spark, at)
    spark.createDataFrame([("a\r",), ("",)], "line string").coalesce(1).write.text(f"{at}/lines")
    assert line_count(spark, f"{at}/lines").first()[0] == 2
    assert remove(spark, at) and not exists(spark, at) and not remove(spark, at)


def test_misc(spark):
    row = spark.sql("SELECT timestamp'2024-03-09 01:02:03' AS t, 'a' AS a, 'b' AS b, X'C3A9' AS good, X'C3' AS bad").select(
        misc.readable_time(F.col("t")), misc.valid_utf8(F.col("good")), misc.valid_utf8(F.col("bad")), F.length(misc.random_text(12, 5)),
        misc.combined_hash(F.col("a"), F.col("b")) == misc.combined_hash(F.col("b"), F.col("a")), misc.key_hash(F.col("a")) == misc.key_hash(F.lit("a")),
    ).first()
    assert list(row) == ["20240309010203", True, False, 12, False, True]


def test_result_lines(spark):
    d = Dictionary(spark.createDataFrame([("a", 3)], "key string, value long"))
    assert [r[0] for r in result_lines(d.df).collect()] == ["[a]->[3]"] and [r[0] for r in result_lines(d.df.select("key")).collect()] == ["[a]"]


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "in").write_text("b,2\na,1\nc,3\n")
    at = str(tmp_path / "d")
    assert main(["map", "-f", str(tmp_path / "in"), "-o", at, "-c", "10", "-w", "/tmp", "-t", "2", "-l", "3", "-p", "2"], spark) == 0
    assert main(["sort", "-f", str(tmp_path / "in"), "-o", str(tmp_path / "s"), "-w", "/tmp", "-t", "2", "-s", "3", "-p", "2"], spark) == 0
    assert main(["match", "-f", at, "-q", "b"], spark) == 0 and capsys.readouterr().out == "[b]->[2]\n"
    assert main(["match", "-f", at, "-q", "x"], spark) == 1
    assert main(["range", "-f", at, "-a", "b"], spark) == 0 and capsys.readouterr().out == "[b]->[2]\n[c]->[3]\n"
    assert main(["prefix", "-f", at, "-p", "a", "-e", "c"], spark) == 0 and capsys.readouterr().out == "[a]->[1]\n"
    assert main(["dot", "-f", at, "-o", str(tmp_path / "x.dot")], spark) == 0 and (tmp_path / "x.dot").exists()
    assert main(["dot", "-f", at, "-o", str(tmp_path / "none" / "x.dot")], spark) == 1
    with pytest.raises(SystemExit):
        main(["fuzzy", "-f", at, "-z", "x", "-d", "101"], spark)


def test_batch(spark):
    d = Dictionary(spark.createDataFrame([("there", 1), ("tree", 2), ("free", 3)], "key string, value long"))
    rows = spark.createDataFrame([("there",), ("three",), (None,)], "w string")
    assert {tuple(r) for r in lookup(rows, d, "w").collect()} == {("there", 1), ("three", None), (None, None)}
    assert [r["w"] for r in members(rows, d, "w").collect()] == ["there"]
    assert {r["w"] for r in strangers(rows, d, "w").collect()} == {"three", None}
    assert {tuple(r) for r in fuzzy_join(rows, d, "w", 1).collect()} == {("there", "there", 0), ("three", "tree", 1)}
    assert {tuple(r) for r in fuzzy_join(rows, d, "w", 2).collect()} == {("there", "there", 0), ("there", "tree", 2), ("three", "there", 2), ("three", "tree", 1), ("three", "free", 2)}


def test_stream(spark, tmp_path):
    d = Dictionary(spark.createDataFrame([("a", 1)], "key string, value long"))
    spark.createDataFrame([("a",), ("b",)], "w string").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("w string").parquet(str(tmp_path / "s"))
    q = enriched(stream, d, "w").writeStream.format("memory").queryName("enriched").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("enriched").collect()} == {("a", 1), ("b", None)}
