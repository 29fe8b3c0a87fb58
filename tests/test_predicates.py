import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dictspark.functions.distance import osa_distance
from dictspark.operators.compat import compat
from dictspark.operators.dictionary import Dictionary
from dictspark.operators.predicate import Always, And, GreaterThan, LessThan, Lev, Not, Or, Osa, Prefix, StartsWith, Str, Where
from dictspark.operators.query import Bounds, filtered, fuzzy, match, prefix, range_, scan


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
    return row[-1]


def osa(a, b):
    d = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i, j] = i + j
                continue
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


rng = random.Random(7)
KEYS = sorted({"", "中国", "中国人", "国中", "a'b", "a\nb", *("".join(rng.choice("abcé中") for _ in range(rng.randint(0, 6))) for _ in range(400))}, key=lambda s: s.encode())
BASES = [
    (Always(), lambda k: True),
    (Str("ab"), lambda k: k == "ab"),
    (Str(""), lambda k: k == ""),
    (Prefix("a"), lambda k: k.startswith("a")),
    (Prefix(""), lambda k: True),
    (GreaterThan("b", True), lambda k: k.encode() >= b"b"),
    (GreaterThan(""), lambda k: k != ""),
    (LessThan("中", True), lambda k: k.encode() <= "中".encode()),
    (LessThan("", True), lambda k: k == ""),
    (Lev("abc", 1), lambda k: lev(k, "abc") <= 1),
    (Lev("", 2), lambda k: len(k) <= 2),
    (Lev("中国", 1), lambda k: lev(k, "中国") <= 1),
    (Osa("ca", 1), lambda k: osa(k, "ca") <= 1),
    (Osa("中é", 2), lambda k: osa(k, "中é") <= 2),
    (Osa("", 1), lambda k: len(k) <= 1),
    (Osa("ab", 0), lambda k: k == "ab"),
]


@pytest.fixture(scope="module")
def keys(spark):
    return Dictionary(spark.createDataFrame([(k, i) for i, k in enumerate(KEYS)], "key string, value long").cache())


def found(d, p, bounds=None):
    return [r["key"] for r in scan(d, p, bounds).collect()]


@pytest.mark.parametrize("i", range(len(BASES)))
def test_bases_and_what_is_made_of_them(keys, i):
    p, f = BASES[i]
    q, g = BASES[(i * 7 + 3) % len(BASES)]
    assert found(keys, p) == [k for k in KEYS if f(k)]
    assert found(keys, Not(p)) == [k for k in KEYS if not f(k)]
    assert found(keys, p & q) == [k for k in KEYS if f(k) and g(k)]
    assert found(keys, p | q) == [k for k in KEYS if f(k) or g(k)]
    assert found(keys, ~(p & q)) == found(keys, Not(p) | Not(q))
    assert found(keys, StartsWith(p)) == [k for k in KEYS if any(f(k[:n]) for n in range(len(k) + 1))]


def test_algebra_matches_sets(keys):
    a, b = Prefix("a"), Lev("abc", 2)
    both = {r["key"] for r in filtered(keys, a).intersect(filtered(keys, b)).collect()}
    assert both == set(found(keys, And(a, b)))
    assert found(keys, And()) == KEYS and found(keys, Or()) == []
    assert found(keys, StartsWith(Or(Str("a"), Lev("bb", 1)))) == [k for k in KEYS if k.startswith("a") or any(lev(k[:n], "bb") <= 1 for n in range(len(k) + 1))]
    assert found(keys, Where(lambda k: F.length(k) == 3)) == [k for k in KEYS if len(k) == 3]


@pytest.mark.parametrize("b", [Bounds(), Bounds(ge="b"), Bounds(gt="b"), Bounds(le="c"), Bounds(lt="c"), Bounds(ge="a", gt="z", le="c", lt="a"), Bounds(ge="", lt="")])
def test_bounds(keys, b):
    low = (lambda k: k >= b.ge.encode()) if b.ge else (lambda k: k > b.gt.encode()) if b.gt else (lambda k: True)
    high = (lambda k: k <= b.le.encode()) if b.le else (lambda k: k < b.lt.encode()) if b.lt else (lambda k: True)
    assert [r["key"] for r in range_(keys, b).collect()] == [k for k in KEYS if low(k.encode()) and high(k.encode())]


def test_queries(keys):
    assert [r["key"] for r in match(keys, "中国").collect()] == ["中国"]
    assert match(keys, "中国", Bounds(lt="b")).collect() == []
    assert [r["key"] for r in prefix(keys, "中", Bounds(gt="中a")).collect()] == [k for k in KEYS if k.startswith("中") and k.encode() > "中a".encode()]
    assert [r["key"] for r in fuzzy(keys, "abc", 2, same_prefix=1).collect()] == [k for k in KEYS if k.startswith("a") and lev(k, "abc") <= 2]
    assert [r["key"] for r in fuzzy(keys, "ab", 2, same_prefix=9, damerau=True).collect()] == [k for k in KEYS if k.startswith("ab") and osa(k, "ab") <= 2]


@settings(max_examples=12, deadline=None)
@given(st.text("abc中", max_size=6), st.integers(0, 3))
def test_distances_of_any_pattern(keys, q, d):
    assert found(keys, Lev(q, d)) == [k for k in KEYS if lev(k, q) <= d]
    assert found(keys, Osa(q, d)) == [k for k in KEYS if osa(k, q) <= d]


def test_osa_is_the_restricted_distance(spark):
    rows = spark.createDataFrame([("ca",), ("",), ("abc",)], "key string").select(osa_distance(F.col("key"), "abc").alias("d")).collect()
    assert [r["d"] for r in rows] == [3, 3, 0]


def test_pushdown(spark, tmp_path):
    Dictionary(spark.createDataFrame([("a", 1)], "key string, value long")).save(str(tmp_path / "d"))
    plan = lambda p: scan(Dictionary.load(spark, str(tmp_path / "d")), p)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(key,ab)" in plan(Prefix("ab"))
    assert "GreaterThanOrEqual(key,ab)" in plan(GreaterThan("ab", True))
    with pytest.raises(ValueError):
        spark.createDataFrame([(1,)], "x int").write.parquet(str(tmp_path / "x"))
        Dictionary.load(spark, str(tmp_path / "x"))


# Words within two edits of "hair", and words that are so only where swapped neighbours are one edit.
HAIR = """ai aid ail aim air airs airy ais ait bail bairn bar bhai cairn car carr chai chain chair chairs char choir coir dai dairy ear emir fail fair fairs
fairy far fir flair gar glair ha haar haars hack had haft hag hah haik hail hails hair hairdo haired hairs hairy haj hajis hake hale half hall halo halt ham hand hank hap
haps hard hare hark harm harp hart has hash hat hate haul have haw hawk hay hazy hear heir heirs her hi hid him hin hip hire his hit hoar hoer hoor hour hui jar kail lair laird
lar maar maid main mar mohair nadir noir oar paid pain pair pairs par rai raid rain said sail sir stair stir tail tapir tar their vair wait war weir whir zaire""".split()
SWAPPED = "ahi ahis lari liar sari zari".split()


def test_words_near_hair(spark):
    others = "house hairdresser a hhaaiirr chairman the".split()
    keys = spark.createDataFrame([(w,) for w in HAIR + SWAPPED + others], "key string")
    held = lambda p: {r[0] for r in keys.where(p.column(F.col("key"))).collect()}
    assert held(Lev("hair", 2)) == set(HAIR)
    assert held(Osa("hair", 2)) - held(Lev("hair", 2)) == set(SWAPPED)


def test_compat(spark):
    keys = spark.createDataFrame([(w,) for w in ("", "a", "ab", "é")], "key string")
    held = lambda p: {r[0] for r in keys.where(compat(p).column(F.col("key"))).collect()}
    assert held(Str("")) == held(Prefix("")) == set() and held(~Str("")) == {"", "a", "ab", "é"}
    assert held(GreaterThan("", True)) == held(GreaterThan("")) == {"a", "ab", "é"} and held(LessThan("", True)) == held(LessThan("")) == {""}
    assert held(Lev("", 0)) == held(Osa("", 0)) == {"a", "é"} and held(Lev("", 1) & Prefix("a")) == {"a", "ab"}
    assert held(Prefix("a")) == {"a", "ab"} and held(StartsWith(Str(""))) == set()
