"""The minimal transducer of a dictionary as tables of nodes and edges, and as Graphviz text.

Keys are byte strings. A prefix's output is the least value below it; an edge puts out what its end adds to its start, and a final node what
its key's value adds to that. Prefixes with the same set of (suffix, value above the prefix's output) are one node. A node's number is
the place of its least prefix in bytewise order, which is the order of a depth-first walk.

Sets are told apart by sums over their members, so nothing is gathered below a prefix: a prefix of all keys is an aggregation with partial
sums like any other. For several hashes h of suffixes, modulo a prime, the sums of h and of h * value are kept; with the least value m
below the prefix, the second less m times the first is the sum of h * (value - m), a fingerprint of the set that needs no second pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dictspark.operators.dictionary import Dictionary
from dictspark.operators.linesort import ranked
from dictspark.storage import stored

_VALUE = "decimal(20,0)"
#: Edges that a drawing has at most.
DRAWN = 100_000


@dataclass(frozen=True)
class Graph:
    """nodes: node_id, is_final, final_output. edges: src, dst, byte, output."""

    nodes: DataFrame
    edges: DataFrame


#: A prime below 2^31, so that products fit into a long, and the number of hashes: two sets are taken for one with a chance of about 2^-120.
_PRIME, _HASHES = (1 << 31) - 1, 4


def transducer(d: Dictionary) -> Graph:
    """For dictionaries, whose keys are short: a key of n bytes makes n + 1 rows."""
    value = F.col("value").cast(_VALUE) if d.has_values else F.lit(0).cast(_VALUE)
    modulo = lambda c: F.pmod(c, F.lit(_PRIME).cast(_VALUE)).cast("long")
    keys = d.df.select(F.encode("key", "UTF-8").alias("key"), value.alias("value")).withColumn("v", modulo(F.col("value")))
    cuts = keys.withColumn("n", F.explode(F.sequence(F.lit(0), F.octet_length("key"))))
    below = cuts.select(F.expr("substring(key, 1, n)").alias("prefix"), F.expr("substring(key, n + 1)").alias("suffix"), "value", "v")
    below = below.withColumns({f"h{j}": F.pmod(F.xxhash64("suffix", F.lit(j)), F.lit(_PRIME)) for j in range(_HASHES)})
    sums = [x for j in range(_HASHES) for x in (F.sum(f"h{j}").alias(f"s{j}"), F.sum(F.col(f"h{j}") * F.col("v") % _PRIME).alias(f"t{j}"))]
    each = below.groupBy("prefix").agg(F.min("value").alias("least"), F.max(F.when(F.octet_length("suffix") == 0, F.col("value"))).alias("top"), F.count("*").alias("n"), *sums)
    acc = F.when(F.octet_length("prefix") == 0, F.lit(0)).otherwise(F.col("least")).cast(_VALUE)
    above = [F.pmod(F.col(f"t{j}") - F.col(f"s{j}") % _PRIME * F.col("m") % _PRIME, F.lit(_PRIME)) for j in range(_HASHES)]
    members = ["n", *(F.col(f"s{j}") for j in range(_HASHES)), *above]
    each = each.withColumn("acc", acc).withColumn("m", modulo(F.col("acc")))
    each = each.select("prefix", "acc", (F.col("top") - F.col("acc")).cast(_VALUE).alias("own"), F.xxhash64(*members).alias("k1"), F.xxhash64(F.lit(1), *members).alias("k2"))
    each = stored(each, "graph-prefixes")
    kind, byte = ["k1", "k2"], F.conv(F.hex(F.expr("substring(prefix, -1)")), 16, 10).cast("int")
    numbered = ranked(each.groupBy(*kind).agg(F.min("prefix").alias("prefix"), F.max("own").alias("own")), F.col("prefix")).withColumn("node_id", F.col("place") - 1)
    nodes = numbered.select("node_id", F.col("own").isNotNull().alias("is_final"), F.coalesce("own", F.lit(0)).cast(_VALUE).alias("final_output"))
    starts = numbered.select(F.col("prefix").alias("up"), F.col("node_id").alias("src")).join(each.select(F.col("prefix").alias("up"), F.col("acc").alias("before")), "up")
    ends = each.where(F.octet_length("prefix") > 0).select(F.expr("substring(prefix, 1, octet_length(prefix) - 1)").alias("up"), byte.alias("byte"), "acc", *kind)
    linked = ends.join(starts, "up").join(numbered.select(*kind, F.col("node_id").alias("dst")), kind)
    return Graph(nodes, linked.select("src", "dst", "byte", (F.col("acc") - F.col("before")).cast(_VALUE).alias("output")))


def graph_stats(g: Graph) -> DataFrame:
    """One row: n_nodes, n_final, n_edges."""
    both = g.nodes.select("is_final", F.lit(1).alias("node")).union(g.edges.select(F.lit(False), F.lit(0)))
    return both.agg(F.sum("node").alias("n_nodes"), F.count_if("is_final").alias("n_final"), F.sum(1 - F.col("node")).alias("n_edges"))


def path_sums(g: Graph, keys: DataFrame) -> DataFrame:
    """key and value of those of the given keys that the graph holds: each walks from the root byte by byte, adding up the edges' outputs, and ends
    in a final node, whose output is added. A round for each byte of the longest key: a join of the walkers with the edges."""
    walkers = keys.select("key", F.hex(F.encode("key", "UTF-8")).alias("bytes"), F.lit(0).cast("long").alias("src"), F.lit(0).cast(_VALUE).alias("sum"))
    longest = walkers.agg(F.coalesce(F.max(F.length("bytes")), F.lit(0))).first()[0] // 2
    edges, arrived = g.edges.select("src", "byte", "dst", "output"), []
    for i in range(longest + 1):
        arrived.append(walkers.where(F.length("bytes") == 2 * i).select("key", F.col("src").alias("node_id"), "sum"))
        step = walkers.where(F.length("bytes") > 2 * i).withColumn("byte", F.conv(F.substring("bytes", 2 * i + 1, 2), 16, 10).cast("int"))
        walkers = step.join(edges, ["src", "byte"]).select("key", "bytes", F.col("dst").alias("src"), (F.col("sum") + F.col("output")).cast(_VALUE).alias("sum"))
        if i % 4 == 3:  # the walk is cut where the plan grows long
            walkers = stored(walkers, "graph-walk")
    done = arrived[0]
    for part in arrived[1:]:
        done = done.union(part)
    return done.join(g.nodes.where("is_final"), "node_id").select("key", (F.col("sum") + F.col("final_output")).cast(_VALUE).alias("value"))


def _escaped(c: str) -> str:
    return c.replace("\\", "\\\\").replace('"', '\\"')


def _last_character(path: list[tuple[int, list[str]]]) -> list[tuple[int, list[str]]]:
    """The bytes at the end of the path that make a whole character of several bytes, if they do."""
    for i in range(len(path) - 1, max(-1, len(path) - 5), -1):
        byte = path[i][0]
        if byte >= 0xC0:
            size = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
            return path[i:] if len(path) - i == size else []
        if byte < 0x80:
            break
    return []


def dot_lines(d: Dictionary) -> Iterator[str]:
    """Graphviz text of the transducer: nodes in the order of a depth-first walk, an edge after what lies below it. An edge of a byte beyond ASCII
    names the characters that it is part of on the paths walked, and its place in them. Quotes and backslashes are escaped. A drawing is
    for small dictionaries: nodes and edges come to the driver, which is refused beyond DRAWN edges."""
    g = transducer(d)
    edges = g.edges.limit(DRAWN + 1).collect()
    if len(edges) > DRAWN:
        raise ValueError(f"the graph has more than {DRAWN} edges, too many to draw")
    nodes = {r["node_id"]: r for r in g.nodes.collect()}
    out: dict[int, list] = {}
    for e in sorted(edges, key=lambda e: (e["src"], e["byte"])):
        out.setdefault(e["src"], []).append(e)
    yield from ("digraph fst {", '\t\tlabelloc="l";', '\t\tlabeljust="l";', '\t\trankdir="UD";', "")
    drawn: set[int] = set()
    path: list[tuple[int, list[str]]] = []  # bytes, each with the characters it was seen in
    todo: list[tuple] = [(None, 0)] if nodes else []
    while todo:
        edge, at = todo.pop()
        if at is None:  # everything below the edge is drawn
            byte, names = path.pop()
            label = _escaped(chr(byte)) if byte < 0x80 else f"0x{byte:x}[{','.join(names)}]"
            more = f"/{edge['output']}" if edge["output"] > 0 else ""
            yield f'\t\t{edge["src"]} -> {edge["dst"]} [label="{label}{more}"]'
            continue
        if edge is not None:
            path.append((edge["byte"], []))
            todo.append((edge, None))
            whole = _last_character(path)
            character = bytes(b for b, _ in whole).decode("utf-8", "replace")
            for i, (_, names) in enumerate(whole):
                names.append(f"{character}[{i + 1}]")
        if at not in drawn:
            drawn.add(at)
            node = nodes[at]
            more = f"/{node['final_output']}" if node["final_output"] > 0 else ""
            yield f'\t\t{at}[label="{at}{more}"{",peripheries=2" if node["is_final"] else ""}]'
            todo += [(e, e["dst"]) for e in reversed(out.get(at, []))]
    yield "}"


def dot_table(g: Graph) -> DataFrame:
    """line: the drawing's lines for nodes and for edges of ASCII bytes, in no order; for graphs of any size."""
    more = lambda c: F.when(F.col(c) > 0, F.concat(F.lit("/"), F.col(c).cast("string"))).otherwise("")
    number = lambda c: F.col(c).cast("string")
    rings = F.when(F.col("is_final"), F.lit(",peripheries=2")).otherwise(F.lit(""))
    nodes = g.nodes.select(F.concat(F.lit("\t\t"), number("node_id"), F.lit('[label="'), number("node_id"), more("final_output"), F.lit('"'), rings, F.lit("]")).alias("line"))
    label = F.regexp_replace(F.char("byte"), r'(["\\])', r"\\$1")
    edges = g.edges.where("byte < 128").select(F.concat(F.lit("\t\t"), number("src"), F.lit(" -> "), number("dst"), F.lit(' [label="'), label, more("output"), F.lit('"]')).alias("line"))
    return nodes.union(edges)
