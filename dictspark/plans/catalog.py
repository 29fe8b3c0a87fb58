"""The library's own queries with the SQL that gives the same rows.

Dictionaries: V, the words of the documents and their counts; C, customers by name; P, parts by name (names recur); N, nations by name. V and C
are built once in a session, saved in the shared folder and loaded by each query.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dictspark.functions import misc, strings
from dictspark.functions.arrow import word_counts
from dictspark.operators import batch, graph
from dictspark.operators.compat import compat
from dictspark.operators.dictionary import Dictionary, build_map, build_set, map_from_lines, set_from_lines
from dictspark.operators.linesort import place_lines, ranked, sort_file
from dictspark.operators.predicate import GreaterThan, LessThan, Lev, Osa, Predicate, Prefix, StartsWith, Str, Where
from dictspark.operators.query import Bounds, filtered, fuzzy, hit_count, match, prefix, range_, result_lines, scan
from dictspark.sources.text import line_count, line_report, read_lines
from dictspark.storage import new_path, spread, version

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the documents, each with its occurrences in a part of these."""
    return word_counts(spread(_table(spark, sf_dir, "documents").select("text")))


_SAVED: dict[tuple, str] = {}


def saved(spark: SparkSession, sf_dir: str, table: str, build: Callable[[SparkSession, str], Dictionary]) -> Dictionary:
    """The dictionary as loaded from where it was saved; built where this session has none of the table as it is now."""
    key = (spark.sparkContext.applicationId, build.__name__, sf_dir, version(spark, f"{sf_dir}/{table}.parquet"))
    if key not in _SAVED:
        path = new_path(spark, f"dictionary-{build.__name__}")
        build(spark, sf_dir).save(path)
        _SAVED[key] = path
    return Dictionary.load(spark, _SAVED[key])


def vocabulary(spark: SparkSession, sf_dir: str) -> Dictionary:
    return Dictionary(_words(spark, sf_dir).groupBy("key").agg(F.sum("n").alias("value")))


def customers(spark: SparkSession, sf_dir: str) -> Dictionary:
    return build_map(_table(spark, sf_dir, "customer"), "c_name", "c_custkey")


def parts(spark: SparkSession, sf_dir: str) -> Dictionary:
    line = F.concat(F.col("p_name"), F.lit(","), F.col("p_partkey").cast("string"))
    return build_map(_table(spark, sf_dir, "part"), "p_name", "p_partkey", order=line)


def nations(spark: SparkSession, sf_dir: str) -> Dictionary:
    return build_map(_table(spark, sf_dir, "nation"), "n_name", "n_nationkey")


def on_vocabulary(f: Callable[[Dictionary], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(saved(spark, sf_dir, "documents", vocabulary))


def on_customers(f: Callable[[Dictionary], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(saved(spark, sf_dir, "customer", customers))


def dict_map_presorted_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the order of their part keys, the last of a name wins."""
    return build_map(_table(spark, sf_dir, "part"), "p_name", "p_retailprice", order=F.col("p_partkey")).df


def _part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    return p.select(F.concat_ws(",", "p_name", F.col("p_partkey").cast("string"), "p_brand").alias("line"), F.col("p_partkey").alias("line_no"))


def dict_map_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = map_from_lines(_part_lines(spark, sf_dir))
    return d.df.select("key", F.col("value").cast("long").alias("value"))


def _document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' lines, each document followed by an empty line and one of white space."""
    text = F.split(F.concat("text", F.lit("\n\n \t")), "\n")
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text).alias("pos", "line")).select("line", F.struct("doc_id", "pos").alias("line_no"))


def _as_file(lines: DataFrame, name: str) -> str:
    """The lines written as text files, in order."""
    path = new_path(lines.sparkSession, name)
    lines.orderBy("line_no").select("line").write.option("lineSep", "\n").text(path)
    return path


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines of files with their places."""
    return ranked(lines, F.col("line_no")).select("line", F.col("place").cast("long").alias("place"))


def text_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(read_lines(spark, _as_file(_part_lines(spark, sf_dir), "parts")))


def sorted_file(spark: SparkSession, sf_dir: str, keep_empty: bool) -> DataFrame:
    """The documents' lines as a file, sorted into another file, which is read again."""
    out = new_path(spark, "sorted")
    sort_file(spark, _as_file(_document_lines(spark, sf_dir), "lines"), out, keep_empty)
    return _numbered(read_lines(spark, out))


def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_count(spark, _as_file(_document_lines(spark, sf_dir), "lines"))


def strict_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' priorities and keys as lines that come by order key: what a builder of ascending keys takes."""
    o = _table(spark, sf_dir, "orders")
    lines = o.select(F.concat_ws(",", F.format_string("%s-%05d", F.substring("o_orderpriority", 1, 1), F.pmod("o_orderkey", F.lit(1000))), "o_orderstatus").alias("line"), F.col("o_orderkey").alias("line_no"))
    return set_from_lines(lines, presorted=True, strict=True).df


def dict_line_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_document_lines(spark, sf_dir))


def parse_uint64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers cut out of the events' properties, with signs, blanks and tails put around them."""
    e = _table(spark, sf_dir, "events").select("event_id", F.regexp_extract("props", "([0-9]+)", 1).alias("n"))
    forms = F.array(F.col("n"), F.concat(F.lit(" +"), "n"), F.concat("n", F.lit(".5x")), F.concat(F.lit("x"), "n"), F.concat("n", F.lit("99999999999999999999")))
    rows = e.select("event_id", F.posexplode(forms).alias("form", "text"))
    return rows.select("event_id", "form", strings.parse_uint64(F.col("text")).cast("string").alias("value"))


def sort_lines_query(spark: SparkSession, sf_dir: str, keep_empty: bool) -> DataFrame:
    """Lines with their places in the sorted file."""
    placed = place_lines(_document_lines(spark, sf_dir), keep_empty)
    return placed.select("line", F.col("line_no.doc_id").alias("doc_id"), F.col("line_no.pos").alias("pos"), F.col("place").cast("long").alias("place"))


def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trim, split, characters and byte lengths of the customers' names put into blanks."""
    c = _table(spark, sf_dir, "customer")
    text = F.concat(F.lit(" \t"), F.col("c_name"), F.lit("#"), F.col("c_mktsegment"), F.lit(" \r"))
    return c.select(
        "c_custkey",
        strings.trimmed(text).alias("trimmed"),
        F.size(strings.split_fields(text, "#")).cast("long").alias("n_fields"),
        F.array_join(strings.split_fields(strings.trimmed(text), "#", ignore_empty=True), "|").alias("fields"),
        F.size(strings.characters(text)).cast("long").alias("n_chars"),
        F.array_join(F.slice(strings.characters(strings.trimmed(text)), 1, 3), ".").alias("first_chars"),
        strings.is_ascii(text).alias("ascii"),
        F.aggregate(strings.utf8_lengths(text), F.lit(0), lambda a, x: a + x).cast("long").alias("n_bytes"),
        misc.valid_utf8(F.encode(text, "UTF-8")).alias("valid"),
    )


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", misc.readable_time(F.col("ts")).alias("at"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names, pairs of name and brand, and hashes of both."""
    p = _table(spark, sf_dir, "part")
    own = p.select("p_name", "p_brand", misc.key_hash(F.col("p_name")).alias("h"), misc.combined_hash(F.col("p_name"), F.col("p_brand")).alias("hh"))
    return own.agg(F.count_distinct("p_name").alias("names"), F.count_distinct("h").alias("hashes"), F.count_distinct("p_name", "p_brand").alias("pairs"), F.count_distinct("hh").alias("combined"))


def compat_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys accepted by empty patterns, each taken as one character that equals no other, by pattern."""
    d = saved(spark, sf_dir, "documents", vocabulary)
    every = {"str": Str(""), "prefix": Prefix(""), "above": GreaterThan("", True), "below": LessThan("", True), "lev": Lev("", 1), "not": ~Osa("", 0)}
    flags = [compat(p).column(F.col("key")).alias(name) for name, p in every.items()]
    return d.df.select("key", *flags).agg(*[F.count_if(name).alias(name) for name in every])


def _graph_rows(g: graph.Graph, what: str) -> DataFrame:
    if what == "nodes":
        return g.nodes.select(F.col("node_id").cast("long").alias("node_id"), "is_final", F.col("final_output").cast("long").alias("final_output"))
    if what == "edges":
        return g.edges.select(*[F.col(c).cast("long").alias(c) for c in ("src", "dst", "byte", "output")])
    return graph.graph_stats(g)


def path_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's value, added up along the key's path; keys that are not in the graph get none."""
    d = saved(spark, sf_dir, "customer", customers)
    keys = d.df.select("key").union(d.df.select(F.concat("key", F.lit("x"))))
    return graph.path_sums(graph.transducer(d), keys).select("key", F.col("value").cast("long").alias("value"))


def lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    return batch.lookup(p, parts(spark, sf_dir), "name").select("p_partkey", "name", "value")


def _some_names(spark: SparkSession, sf_dir: str) -> Dictionary:
    """Names of the customers in the building segment."""
    c = _table(spark, sf_dir, "customer")
    return build_set(c.where("c_mktsegment = 'BUILDING'"), "c_name")


def member_query(spark: SparkSession, sf_dir: str, inside: bool) -> DataFrame:
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return (batch.members if inside else batch.strangers)(c, _some_names(spark, sf_dir), "c_name").select("c_custkey", "c_name")


def fuzzy_join_d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation").select(F.lower("n_name").alias("name"))
    r = _table(spark, sf_dir, "region").select(F.lower("r_name").alias("name"))
    return batch.fuzzy_join(n.union(r), saved(spark, sf_dir, "documents", vocabulary), "name", 1)


_CNAME = "Customer#00000"
#: Levenshtein in the SQL counts bytes; characters beyond ASCII, which the patterns do not hold, count as one each.
_ASCII = "regexp_replace(key, '[^\\x00-\\x7F]', '#', 'g')"


def _lev(pattern: str, d: int) -> str:
    return f"levenshtein({_ASCII}, '{pattern}') <= {d}"


def _some_prefix(pattern: str, d: int, also: str = "false") -> str:
    near = f"levenshtein(substr({_ASCII}, 1, i), '{pattern}') <= {d} OR {also}"
    return f"list_aggregate(list_transform(range(0, length(key) + 1), lambda i: {near}), 'bool_or')"


_PREDICATES: dict[str, tuple[Predicate, str]] = {
    "pred_and": (Prefix("the") & LessThan("theri", True), "starts_with(key, 'the') AND key <= 'theri'"),
    "pred_or": (Str("there") | Prefix("thing"), "key = 'there' OR starts_with(key, 'thing')"),
    "pred_not": (~Prefix("t"), "NOT starts_with(key, 't')"),
    "pred_startswith_str": (StartsWith(Str("ther")), "starts_with(key, 'ther')"),
    "pred_startswith_lev": (StartsWith(Lev("ther", 1)), _some_prefix("ther", 1)),
    "pred_startswith_osa": (StartsWith(Osa("ten", 1)), _some_prefix("ten", 1, "substr(key, 1, i) IN ('etn', 'tne')")),
    "pred_gt_incl": (GreaterThan("th", True), "key >= 'th'"),
    "pred_gt_excl": (GreaterThan("the"), "key > 'the'"),
    "pred_lt_excl": (LessThan("and"), "key < 'and'"),
    "pred_lt_incl": (LessThan("and", True), "key <= 'and'"),
    "pred_nested": ((Prefix("th") | Lev("ing", 1)) & ~Prefix("the"), f"(starts_with(key, 'th') OR {_lev('ing', 1)}) AND NOT starts_with(key, 'the')"),
    "pred_user": (Where(lambda key: key.rlike("^[aeiou].*[aeiou]$") & (F.length(key) > 4)), "regexp_matches(key, '^[aeiou].*[aeiou]$') AND length(key) > 4"),
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_V = f"""SELECT w AS key, count(*) AS value
FROM (SELECT unnest(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM documents) GROUP BY w"""
_C = "SELECT c_name AS key, max(c_custkey) AS value FROM customer GROUP BY c_name"


def _v(where: str) -> str:
    return f"SELECT key, value FROM ({_V}) WHERE {where}"


def _c(where: str) -> str:
    return f"SELECT key, value FROM ({_C}) WHERE {where}"


def _osa(q: str, d: int, where: str = "true") -> str:
    """The distance's rows as lists, one character of the key at a time."""
    n = len(q)
    cols, prev = [], "i"
    for j in range(1, n + 1):
        swap = f"CASE WHEN i > 1 AND c = '{q[j - 2]}' AND p = '{q[j - 1]}' THEN b[{j - 1}] + 1 ELSE 1000000 END" if j > 1 else "1000000"
        cols.append((f"x{j}", f"least(r[{j + 1}] + 1, {prev} + 1, r[{j}] + CASE WHEN c = '{q[j - 1]}' THEN 0 ELSE 1 END, {swap})"))
        prev = f"x{j}"
    inner = "SELECT key, value, i + 1 AS i, r, b, key[i + 1] AS c, key[i] AS p FROM s WHERE i < length(key)"
    for name, expr in cols:
        inner = f"SELECT *, {expr} AS {name} FROM ({inner})"
    step = f"SELECT key, value, i, [{', '.join(['i', *(c for c, _ in cols)])}] AS r, r AS b FROM ({inner})"
    first = "[" + ", ".join(str(i) for i in range(n + 1)) + "]"
    return f"""WITH RECURSIVE v AS (SELECT * FROM ({_V}) WHERE length(key) BETWEEN {max(0, n - d)} AND {n + d} AND {where}),
s AS (SELECT key, value, 0::BIGINT AS i, {first}::BIGINT[] AS r, {first}::BIGINT[] AS b FROM v UNION ALL SELECT key, value, i, r, b FROM ({step}))
SELECT key, value FROM s WHERE i = length(key) AND r[{n + 1}] <= {d}"""


_LINES = """SELECT doc_id, pos - 1 AS pos, lines[pos] AS line
FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos
  FROM (SELECT doc_id, string_split(concat(text, chr(10), chr(10), ' ', chr(9)), chr(10)) AS lines FROM documents WHERE text IS NOT NULL))"""
_TRIM = "trim(line, concat(' ', chr(9), chr(13), chr(10)))"
_PART_LINES = "SELECT concat(p_name, ',', p_partkey, ',', p_brand) AS line, p_partkey FROM part"


def _graph(keys: str) -> str:
    """nodes and edges of the keys (key, value), by their bytes in hexadecimal digits."""
    return f"""WITH keys AS (SELECT hex(encode(key)) AS key, value::BIGINT AS value FROM ({keys})),
below AS (SELECT key[1:n] AS prefix, key[n + 1:] AS suffix, value FROM (SELECT key, value, unnest(range(0, length(key) + 1, 2)) AS n FROM keys)),
acc AS (SELECT prefix, CASE WHEN prefix = '' THEN 0 ELSE min(value) END AS acc FROM below GROUP BY prefix),
kinds AS (
  SELECT prefix, any_value(acc) AS acc, md5(string_agg(concat(suffix, '>', value - acc), '|' ORDER BY suffix)) AS kind, max(CASE WHEN suffix = '' THEN value - acc END) AS own
  FROM below JOIN acc USING (prefix) GROUP BY prefix),
nodes AS (
  SELECT kind, row_number() OVER (ORDER BY min(prefix)) - 1 AS node_id, bool_or(own IS NOT NULL) AS is_final, max(coalesce(own, 0)) AS final_output, min(prefix) AS rep
  FROM kinds GROUP BY kind),
edges AS (
  SELECT n.node_id AS src, m.node_id AS dst, try_cast('0x' || right(k.prefix, 2) AS BIGINT) AS byte, k.acc - u.acc AS output
  FROM kinds k JOIN kinds u ON u.prefix = left(k.prefix, length(k.prefix) - 2) AND k.prefix <> '' JOIN nodes n ON n.rep = u.prefix JOIN nodes m ON m.kind = k.kind)"""


_N = "SELECT n_name AS key, max(n_nationkey) AS value FROM nation GROUP BY n_name"
_GRAPH_ROWS = {
    "nodes": "SELECT node_id, is_final, final_output FROM nodes",
    "edges": "SELECT src, dst, byte, output FROM edges",
    "stats": "SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM nodes WHERE is_final) AS n_final, (SELECT count(*) FROM edges) AS n_edges",
}
_DOT = """SELECT concat(chr(9), chr(9), node_id, '[label="', node_id, CASE WHEN final_output > 0 THEN concat('/', final_output) ELSE '' END, '"', CASE WHEN is_final THEN ',peripheries=2' ELSE '' END, ']') AS line
FROM nodes UNION ALL
SELECT concat(chr(9), chr(9), src, ' -> ', dst, ' [label="', chr(byte::INTEGER), CASE WHEN output > 0 THEN concat('/', output) ELSE '' END, '"]') AS line FROM edges WHERE byte < 128"""
_BUILDING = "(SELECT DISTINCT c_name FROM customer WHERE c_mktsegment = 'BUILDING')"
_STRICT = """WITH l AS (SELECT concat(left(o_orderpriority, 1), '-', lpad((o_orderkey % 1000)::VARCHAR, 5, '0')) AS key, o_orderkey FROM orders),
g AS (SELECT key, max(key) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM l)
SELECT DISTINCT key FROM g WHERE top IS NULL OR key >= top OR starts_with(top, key)"""
#: One character more, less or another.
_ONE_EDIT = """length(name) = length(key) AND len(list_filter(range(1, length(key) + 1), lambda i: name[i] <> key[i])) <= 1
  OR length(key) = length(name) + 1 AND len(list_filter(range(1, length(key) + 1), lambda i: concat(key[1:i - 1], key[i + 1:]) = name)) > 0
  OR length(name) = length(key) + 1 AND len(list_filter(range(1, length(name) + 1), lambda i: concat(name[1:i - 1], name[i + 1:]) = key)) > 0"""


def _uint64_sql() -> str:
    forms = ["n", "concat(' +', n)", "concat(n, '.5x')", "concat('x', n)", "concat(n, '99999999999999999999')"]
    rows = " UNION ALL ".join(f"SELECT event_id, {i} AS form, {f} AS t FROM e" for i, f in enumerate(forms))
    return f"""WITH e AS (SELECT event_id, regexp_extract(props, '([0-9]+)', 1) AS n FROM events), t AS ({rows}),
d AS (SELECT event_id, form, regexp_extract(t, '^\\s*\\+?([0-9]+)', 1) AS d FROM t)
SELECT event_id, form::INTEGER AS form, CASE WHEN d = '' THEN '0' ELSE least(try_cast(d AS HUGEINT), 18446744073709551615::HUGEINT)::VARCHAR END AS value FROM d"""


def _strings_sql() -> str:
    trimmed = "trim(concat(' ', chr(9), c_name, '#', c_mktsegment, ' ', chr(13)), concat(' ', chr(9), chr(13), chr(10)))"
    return f"""WITH t AS (SELECT c_custkey, concat(' ', chr(9), c_name, '#', c_mktsegment, ' ', chr(13)) AS t, {trimmed} AS s FROM customer)
SELECT c_custkey, s AS trimmed, len(string_split(t, '#')) AS n_fields, array_to_string(list_filter(string_split(s, '#'), lambda x: x <> ''), '|') AS fields,
length(t) AS n_chars, array_to_string([s[1], s[2], s[3]], '.') AS first_chars, strlen(t) = length(t) AS ascii, strlen(t) AS n_bytes, true AS valid FROM t"""


def _sorted_sql(keep_empty: bool, ids: bool) -> str:
    own = "doc_id, pos::INTEGER AS pos, " if ids else ""
    return f"SELECT line, {own}row_number() OVER (ORDER BY {_TRIM}, doc_id, pos) AS place FROM ({_LINES})" + ("" if keep_empty else f" WHERE {_TRIM} <> ''")


_BUILDS: dict[str, tuple[Query, str]] = {
    "dict_set_build": (lambda spark, d: build_set(_words(spark, d)).df, f"SELECT key FROM ({_V})"),
    "dict_map_build": (lambda spark, d: vocabulary(spark, d).df, _V),
    "dict_map_last_wins": (lambda spark, d: parts(spark, d).df, "SELECT p_name AS key, arg_max(p_partkey, concat(p_name, ',', p_partkey)) AS value FROM part GROUP BY 1"),
    "dict_map_presorted_last": (dict_map_presorted_last, "SELECT p_name AS key, arg_max(p_retailprice, p_partkey) AS value FROM part GROUP BY 1"),
    "dict_map_from_lines": (dict_map_from_lines, "SELECT p_name AS key, arg_max(p_partkey, concat(p_name, ',', p_partkey, ',', p_brand)) AS value FROM part GROUP BY 1"),
    "dict_set_from_lines": (lambda spark, d: set_from_lines(_part_lines(spark, d)).df, "SELECT DISTINCT p_name AS key FROM part"),
    "dict_set_strict": (strict_set, _STRICT),
    "dict_reload": (on_vocabulary(lambda d: d.df), _V),
    "dict_line_validation": (
        dict_line_validation,
        f"""SELECT count(*) AS n_lines, count(*) FILTER (line = '') AS n_empty, count(*) FILTER (line <> '' AND NOT contains(line, ',')) AS n_short,
count(*) FILTER (contains(line, ',')) AS n_map, count(*) FILTER (line <> '') AS n_set FROM ({_LINES})""",
    ),
    "parse_uint64": (parse_uint64, _uint64_sql()),
    "string_functions": (string_functions, _strings_sql()),
    "readable_times": (times, "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS at FROM events"),
    "key_hashes": (hashes, "SELECT count(DISTINCT p_name) AS names, count(DISTINCT p_name) AS hashes, count(DISTINCT (p_name, p_brand)) AS pairs, count(DISTINCT (p_name, p_brand)) AS combined FROM part"),
    "text_source": (text_source, f"SELECT line, row_number() OVER (ORDER BY p_partkey) AS place FROM ({_PART_LINES})"),
    "file_line_count": (file_lines, f"SELECT count(*) AS n_lines FROM ({_LINES})"),
}
_QUERIES: dict[str, tuple[Query, str]] = {
    "match_hit": (on_customers(lambda d: match(d, "Customer#000000042")), _c("key = 'Customer#000000042'")),
    "match_miss": (on_customers(lambda d: match(d, "Customer#x")), _c("key = 'Customer#x'")),
    "match_word": (on_vocabulary(lambda d: match(d, "the")), _v("key = 'the'")),
    "match_bounded_in": (on_customers(lambda d: match(d, "Customer#000000042", Bounds(ge="Customer#00000004", lt="Customer#00000005"))), _c("key = 'Customer#000000042'")),
    "match_bounded_out": (on_customers(lambda d: match(d, "Customer#000000042", Bounds(gt="Customer#000000042"))), _c("false")),
    "prefix_scan": (on_vocabulary(lambda d: prefix(d, "ther")), _v("starts_with(key, 'ther')")),
    "prefix_accented": (on_vocabulary(lambda d: prefix(d, "é")), _v("starts_with(key, 'é')")),
    "prefix_bounded": (
        on_customers(lambda d: prefix(d, f"{_CNAME}00", Bounds(gt=f"{_CNAME}0010", le=f"{_CNAME}0050"))),
        _c(f"starts_with(key, '{_CNAME}00') AND key > '{_CNAME}0010' AND key <= '{_CNAME}0050'"),
    ),
    "prefix_set": (lambda spark, d: prefix(build_set(_table(spark, d, "part"), "p_name"), "b"), "SELECT DISTINCT p_name AS key FROM part WHERE starts_with(p_name, 'b')"),
    "range_ge_lt": (on_customers(lambda d: range_(d, Bounds(ge=f"{_CNAME}0020", lt=f"{_CNAME}0030"))), _c(f"key >= '{_CNAME}0020' AND key < '{_CNAME}0030'")),
    "range_gt_le": (on_customers(lambda d: range_(d, Bounds(gt=f"{_CNAME}0020", le=f"{_CNAME}0030"))), _c(f"key > '{_CNAME}0020' AND key <= '{_CNAME}0030'")),
    "range_unbounded": (on_customers(lambda d: range_(d, Bounds(ge=""))), _c("true")),
    "range_ge_beats_gt": (on_customers(lambda d: range_(d, Bounds(ge=f"{_CNAME}0020", gt=f"{_CNAME}0090"))), _c(f"key >= '{_CNAME}0020'")),
    "range_le_beats_lt": (on_customers(lambda d: range_(d, Bounds(le=f"{_CNAME}0090", lt=f"{_CNAME}0020"))), _c(f"key <= '{_CNAME}0090'")),
    "range_vocabulary": (on_vocabulary(lambda d: range_(d, Bounds(ge="tha", lt="thf"))), _v("key >= 'tha' AND key < 'thf'")),
    "seek_lower_bound": (on_vocabulary(lambda d: range_(d, Bounds(ge="thx")).limit(20)), _v("key >= 'thx' ORDER BY key LIMIT 20")),
    "ordered_next": (
        on_vocabulary(lambda d: ranked(filtered(d, Prefix("t"), Bounds(gt="th")), F.col("key"))),
        f"SELECT key, value, row_number() OVER (ORDER BY key) AS place FROM ({_V}) WHERE starts_with(key, 't') AND key > 'th'",
    ),
    "scan_generic": (on_customers(lambda d: scan(d, ~Prefix(f"{_CNAME}000"), Bounds(lt=f"{_CNAME}0100"))), _c(f"NOT starts_with(key, '{_CNAME}000') AND key < '{_CNAME}0100'")),
    "fuzzy_lev_d0": (on_vocabulary(lambda d: fuzzy(d, "the", 0)), _v("key = 'the'")),
    "fuzzy_lev_d1": (on_vocabulary(lambda d: fuzzy(d, "there", 1)), _v(_lev("there", 1))),
    "fuzzy_lev_d2": (on_vocabulary(lambda d: fuzzy(d, "there", 2)), _v(_lev("there", 2))),
    "fuzzy_lev_prefix": (on_vocabulary(lambda d: fuzzy(d, "there", 2, same_prefix=3)), _v(f"starts_with(key, 'the') AND {_lev('there', 2)}")),
    "fuzzy_lev_prefix_long": (on_vocabulary(lambda d: fuzzy(d, "the", 2, same_prefix=9)), _v(f"starts_with(key, 'the') AND {_lev('the', 2)}")),
    "fuzzy_empty_pattern": (on_vocabulary(lambda d: fuzzy(d, "", 2)), _v("length(key) <= 2")),
    "fuzzy_osa_d1": (on_vocabulary(lambda d: fuzzy(d, "there", 1, damerau=True)), _osa("there", 1)),
    "fuzzy_osa_d2": (on_vocabulary(lambda d: fuzzy(d, "there", 2, damerau=True)), _osa("there", 2)),
    "fuzzy_osa_prefix": (on_vocabulary(lambda d: fuzzy(d, "there", 2, same_prefix=1, damerau=True)), _osa("there", 2, "starts_with(key, 't')")),
    "fuzzy_customers": (on_customers(lambda d: fuzzy(d, "Customer#000000042", 1)), _c("levenshtein(key, 'Customer#000000042') <= 1")),
    **{name: (on_vocabulary(partial(lambda p, d: scan(d, p), p)), _v(sql)) for name, (p, sql) in _PREDICATES.items()},
    "compat_patterns": (
        compat_patterns,
        f"""SELECT 0::BIGINT AS str, 0::BIGINT AS prefix, count(*) FILTER (key <> '') AS above, count(*) FILTER (key = '') AS below,
count(*) FILTER (abs(length(key) - 1) <= 1) AS lev, count(*) FILTER (length(key) <> 1) AS not FROM ({_V})""".replace("AS not ", 'AS "not" '),
    ),
    "hit_count": (on_vocabulary(lambda d: hit_count(filtered(d, Prefix("the")))), f"SELECT count(*) AS hits FROM ({_v("starts_with(key, 'the')")})"),
    "result_lines": (on_vocabulary(lambda d: result_lines(prefix(d, "them"))), f"SELECT concat('[', key, ']->[', value, ']') AS line FROM ({_v("starts_with(key, 'them')")})"),
    "lookup_join": (lookup_join, "SELECT p_partkey, p_name AS name, arg_max(p_partkey, concat(p_name, ',', p_partkey)) OVER (PARTITION BY p_name) AS value FROM part"),
    "member_semi": (partial(member_query, inside=True), f"SELECT c_custkey, c_name FROM customer WHERE c_name IN {_BUILDING}"),
    "member_anti": (partial(member_query, inside=False), f"SELECT c_custkey, c_name FROM customer WHERE c_name NOT IN {_BUILDING}"),
    "fuzzy_join_d1": (
        fuzzy_join_d1,
        f"""SELECT name, key AS dict_key, (name <> key)::INTEGER AS distance
FROM (SELECT lower(n_name) AS name FROM nation UNION SELECT lower(r_name) FROM region) JOIN ({_V}) ON abs(length(name) - length(key)) <= 1 AND ({_ONE_EDIT})""",
    ),
}
_SORTS_AND_GRAPHS: dict[str, tuple[Query, str]] = {
    "sort_lines_keep": (partial(sort_lines_query, keep_empty=True), _sorted_sql(True, True)),
    "sort_lines_ignore_empty": (partial(sort_lines_query, keep_empty=False), _sorted_sql(False, True)),
    "sort_file_keep": (partial(sorted_file, keep_empty=True), _sorted_sql(True, False)),
    "sort_file_ignore_empty": (partial(sorted_file, keep_empty=False), _sorted_sql(False, False)),
    **{f"graph_{what}": (on_vocabulary(partial(lambda what, d: _graph_rows(graph.transducer(d), what), what)), f"{_graph(_V)} {sql}") for what, sql in _GRAPH_ROWS.items()},
    "graph_edges_small": (lambda spark, d: _graph_rows(graph.transducer(nations(spark, d)), "edges"), f"{_graph(_N)} {_GRAPH_ROWS['edges']}"),
    "graph_path_sums": (path_sums, _C),
    "dot_lines": (lambda spark, d: graph.dot_table(graph.transducer(nations(spark, d))), f"{_graph(_N)} {_DOT}"),
}
_ALL = {**_BUILDS, **_QUERIES, **_SORTS_AND_GRAPHS}


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items()}
