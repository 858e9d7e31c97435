"""The structure graph of a corpus and the paths from a request's anchors to its items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.frames import cut, saved
from lodestack.functions import paths
from lodestack.functions.match import Terms
from lodestack.operators.catalog import graph_terms, node_type
from lodestack.operators.score import path_types
from lodestack.operators.select import CODE_LIKE, reads_contract

# The kinds of nodes and edges, and hops that a search may take.
NODE_TYPES = "dir file artifact_contract artifact_workflow artifact_schema_template symbol task_state_anchor".split()
EDGE_TYPES = "contains imports constrains depends_on consumes".split()
MAX_HOPS = 2
# What a report adds up for a path's anchor and edges.
SEED_BONUS = {"direct_path": 160, "contract_anchor": 140, "workflow_anchor": 130, "code_anchor": 110, "symbol_anchor": 100, "task_anchor": 80}
PATH_BONUS = {"constrains": 55, "consumes": 50, "depends_on": 35, "imports": 20}
#: Nodes and edges of a path that a report shows.
SHOWN_NODES, SHOWN_EDGES = 5, 4
#: Nodes that stand for several targets: what refers to them has an edge to the group, and each target is a member. One is of all contracts.
GROUP, MEMBER = "group:", "member"
ALL_CONTRACTS = GROUP + "contracts"


def _id(kind: str, c: Column | str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(c) if isinstance(c, str) else c)


def resolve_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(src, dst) of imports (path, wanted: names in the order of trial) among modules (module, path), without those of an item to itself.

    A name stands for the module that is its longest dotted prefix. Prefixes are joined by equality;
    of modules with one name the last path counts.
    """
    modules = modules.groupBy("module").agg(F.max("path").alias("dst"))
    prefix = lambda w: F.transform(F.sequence(F.lit(1), F.size(F.split(w, r"\."))), lambda i: F.array_join(F.slice(F.split(w, r"\."), 1, i), "."))
    tried = imports.withColumn("_import", F.monotonically_increasing_id()).select("path", "_import", F.posexplode("wanted").alias("_trial", "_name")).where("_name <> ''")
    tried = tried.select("path", "_import", "_trial", F.posexplode(prefix(F.col("_name"))).alias("_depth", "module"))
    met = tried.join(modules, "module").groupBy("path", "_import").agg(F.min_by("dst", F.struct("_trial", (-F.col("_depth")))).alias("dst"))
    return met.where("dst <> path").select(F.col("path").alias("src"), "dst").distinct()


def nodes(items: DataFrame, symbols: DataFrame) -> DataFrame:
    """(node, node_type, path) of folders, items, their kinds and their symbols (path, symbol)."""
    files = items.select(_id("file", "path").alias("node"), F.lit("file").alias("node_type"), "path")
    dirs = items.select(F.explode(paths.ancestors("path")).alias("path")).distinct().select(_id("dir", "path").alias("node"), F.lit("dir").alias("node_type"), "path")
    kinds = items.withColumn("node_type", node_type("path", "artifact_type")).where("node_type is not null").select(F.concat_ws(":", "node_type", "path").alias("node"), "node_type", "path")
    named = symbols.select(F.concat_ws(":", F.lit("symbol"), "path", "symbol").alias("node"), F.lit("symbol").alias("node_type"), "path").distinct()
    return files.unionByName(dirs).unionByName(kinds).unionByName(named)


def contains_edges(items: DataFrame, symbols: DataFrame) -> DataFrame:
    """Folder to folder, folder to item, item to its kind's node and to its symbols."""
    above = items.select("path", paths.ancestors("path").alias("up"))
    steps = F.transform(F.sequence(F.lit(1), F.size("up") - 1), lambda i: F.struct(F.get("up", i - 1).alias("a"), F.get("up", i).alias("b")))
    dirs = above.where("size(up) > 1").select(F.inline(steps)).distinct().select(_id("dir", "a").alias("src"), _id("dir", "b").alias("dst"))
    files = above.select(_id("dir", F.element_at("up", -1)).alias("src"), _id("file", "path").alias("dst"))
    kinds = items.withColumn("_n", node_type("path", "artifact_type")).where("_n is not null").select(_id("file", "path").alias("src"), F.concat_ws(":", "_n", "path").alias("dst"))
    named = symbols.select(_id("file", "path").alias("src"), F.concat_ws(":", F.lit("symbol"), "path", "symbol").alias("dst"))
    return dirs.unionByName(files).unionByName(kinds).unionByName(named).withColumn("edge_type", F.lit("contains"))


def target_groups(targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, unit, dst) of what a text that holds the term refers to, and (group, dst) of the groups' members.

    targets: dst, kind and term. Terms that several targets of a kind have are shared (a file's name, the
    words of special names); targets of a kind with the same shared terms are a group. Such a term leads to
    the group, and a term of one target alone to that target, whose unit is its group, if it has one. So
    edges are as many as texts' terms and targets, not as their pairs.
    """
    targets = targets.distinct()
    shared = targets.groupBy("kind", "term").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    marks = targets.join(shared, ["kind", "term"]).groupBy("kind", "dst").agg(F.array_join(F.sort_array(F.collect_list("term")), "\n").alias("_mark"))
    known = marks.groupBy("kind", "_mark").agg(F.count("*").alias("n")).where("n > 1")
    named = F.concat(F.lit(GROUP), "kind", F.lit(":"), F.sha2("_mark", 256))
    members = cut(marks.join(known, ["kind", "_mark"]).select("kind", "dst", named.alias("group")))
    rows = targets.join(shared.withColumn("_shared", F.lit(True)), ["kind", "term"], "left").join(members, ["kind", "dst"], "left")
    grouped = F.col("_shared") & F.col("group").isNotNull()
    refers = rows.select("term", F.coalesce("group", "dst").alias("unit"), F.when(grouped, F.col("group")).otherwise(F.col("dst")).alias("dst"), "kind").distinct()
    return refers, members.select("group", "dst")


class References:
    """What the texts of a corpus refer to: contracts that constrain schemas and templates, workflows that consume them, other items that depend on them.

    An edge stands where a text holds a term of the target. Targets that texts refer to by the same terms are
    reached through a group: an edge to it, and one (of type MEMBER) from it to each of them. So are all
    contracts by workflows that read what contracts define. Each pair of an item and a target is linked in
    one way: an item that refers to a group has no edge of its own to its members. Terms are known from the
    paths of items (path, artifact_type), so a single pass over texts finds them.
    """

    def __init__(self, items: DataFrame):
        targets = items.select("path", node_type("path", "artifact_type").alias("kind"), F.explode(graph_terms("path")).alias("term")).where("kind in ('artifact_schema_template', 'artifact_contract')")
        self.targets = cut(targets.select("kind", F.concat_ws(":", "kind", "path").alias("dst"), "term"))
        self.refers, self.members = target_groups(self.targets)
        self.terms = Terms(self.refers)

    def read(self, items: DataFrame, *more: Column) -> DataFrame:
        """(path, artifact_type, _n, _reads, _parts) of items (path, artifact_type, content), and more columns: what edges() needs of their texts, each put into lower case once.

        _n: the node's kind; _reads: whether code reads what contracts define.
        """
        rows = items.withColumn("_n", node_type("path", "artifact_type"))
        rows = rows.withColumn("_low", F.when(F.col("_n").isNull() | (F.col("_n") != "artifact_schema_template"), F.lower("content")))
        rows = rows.withColumn("_reads", F.when(F.col("artifact_type").isin(CODE_LIKE), F.coalesce(reads_contract("_low"), F.lit(False))).otherwise(False))
        parts = self.terms.parts(F.when(~(F.col("_reads") & (F.col("artifact_type") == "workflow")), F.col("_low")))
        return rows.select("path", "artifact_type", "_n", "_reads", parts.alias("_parts"), *more)

    def edges(self, read: DataFrame) -> DataFrame:
        """(src, dst, edge_type) of what read() gives."""
        template, own_kind = F.col("kind") == "artifact_schema_template", F.col("artifact_type").isin("contract", "workflow")
        case = F.when((F.col("_n") == "artifact_contract") & template, "constrains").when(F.col("_n") == "artifact_workflow", "consumes").when(~own_kind & template, "depends_on")
        own = F.when(F.col("_n").isNotNull(), F.concat_ws(":", "_n", "path")).otherwise(_id("file", "path"))
        met = self.terms.met(read.select("path", "artifact_type", "_n", "_parts"), "_parts").join(self.refers, "term").withColumn("edge_type", case).where("edge_type is not null")
        met = cut(met.select(own.alias("src"), "dst", "unit", "edge_type").where("src <> dst").distinct())
        whole = met.where(F.startswith("dst", F.lit(GROUP)))
        single = met.where(~F.startswith("dst", F.lit(GROUP))).join(whole.select("src", "unit"), ["src", "unit"], "left_anti")
        direct = whole.unionByName(single).select("src", "dst", "edge_type").distinct()
        readers = read.where("_reads and artifact_type = 'workflow'").select(F.concat_ws(":", "_n", "path").alias("src"), F.lit(ALL_CONTRACTS).alias("dst"), F.lit("consumes").alias("edge_type"))
        parts = self.members.unionByName(self.targets.select(F.lit(ALL_CONTRACTS).alias("group"), "dst").distinct())
        return direct.unionByName(readers).unionByName(parts.select(F.col("group").alias("src"), "dst", F.lit(MEMBER).alias("edge_type")))


def reference_edges(items: DataFrame) -> DataFrame:
    """(src, dst, edge_type) of items (path, artifact_type, content) and what their texts refer to; see References."""
    known = References(items)
    return known.edges(saved(known.read(items), "read"))


def _grouped() -> Column:
    return F.startswith("src", F.lit(GROUP)) | F.startswith("dst", F.lit(GROUP))


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair and type once: src <= dst. Edges of a group go into it from who refers to it, and out of it to its members."""
    low, high = F.when(_grouped(), F.col("src")).otherwise(F.least("src", "dst")), F.when(_grouped(), F.col("dst")).otherwise(F.greatest("src", "dst"))
    return edges.where("src <> dst").select(low.alias("src"), high.alias("dst"), "edge_type").distinct()


def build(items: DataFrame, symbols: DataFrame, imports: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and undirected edges of a catalog; symbols: path, symbol; imports: src, dst paths; references: reference_edges()."""
    linked = imports.select(_id("file", "src").alias("src"), _id("file", "dst").alias("dst"), F.lit("imports").alias("edge_type"))
    edges = contains_edges(items, symbols).unionByName(linked).unionByName(references)
    return nodes(items, symbols), cut(undirected(edges))


def type_counts(rows: DataFrame, column: str, kinds: list[str]) -> DataFrame:
    """Rows of every kind, zero included."""
    known = rows.sparkSession.createDataFrame([(k, i) for i, k in enumerate(kinds)], f"{column} string, ord int")
    return known.join(rows.groupBy(column).count(), column, "left").select(column, F.coalesce("count", F.lit(0)).cast("bigint").alias("n"), "ord")


def edge_counts(edges: DataFrame) -> DataFrame:
    """Edges of every type, zero included; an edge to a group counts once for each of its members."""
    sizes = edges.where(F.col("edge_type") == MEMBER).groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("size"))
    more = edges.where(F.startswith("dst", F.lit(GROUP))).groupBy("dst", "edge_type").count().join(sizes, "dst")
    more = more.groupBy("edge_type").agg(F.sum(F.col("count") * F.col("size")).alias("more"))
    plain = type_counts(edges.where(~_grouped()), "edge_type", EDGE_TYPES)
    return plain.join(more, "edge_type", "left").select("edge_type", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), "ord")


def seeds(scored: DataFrame, explicit: list[str], symbols: DataFrame, task_text: str) -> DataFrame:
    """(node, reason): items that the request names, items whose kind's lane hits their path, and the first symbol of an item that stands as a word in the text.

    scored: path, artifact_type, task_hits, contract_hits, code_hits.
    """
    kind = F.col("artifact_type")
    hit = {lane: F.size(f"{lane}_hits") > 0 for lane in ("task", "contract", "code")}
    why = (
        F.when(F.col("path").isin(explicit) if explicit else F.lit(False), "direct_path")
        .when((kind == "contract") & hit["contract"], "contract_anchor").when((kind == "workflow") & (hit["contract"] | hit["code"]), "workflow_anchor")
        .when(kind.isin("selection_logic", "code_snippet") & hit["code"], "code_anchor").when((kind == "supporting_context") & hit["task"], "task_anchor")
    )
    items = scored.select(_id("file", "path").alias("node"), why.alias("reason")).where("reason is not null")
    text = F.lit(task_text.lower())
    low = F.lower("symbol")
    word = F.regexp_like(text, F.concat(F.lit(r"(?U)\b\Q"), low, F.lit(r"\E\b"))) & (F.length("symbol") >= 3)
    first = symbols.where(word).groupBy("path").agg(F.min_by("symbol", "ord").alias("symbol"))
    return items.unionByName(first.select(F.concat_ws(":", F.lit("symbol"), "path", "symbol").alias("node"), F.lit("symbol_anchor").alias("reason")))


_NEXT = "prev prev_hops edge_type n imported reason types".split()  # prev and prev_hops decide types


class Search:
    """Best paths from seeds (node, reason) over edges (undirected(), with groups) to all nodes, by cost and then by hops.

    contains edges are no hops. A path's cost depends on its hops and on whether one of them is an import, so
    states (node, hops) are settled cost by cost and never change again: first those without an import, then the
    others. Within a cost each round goes one edge on; of equally good ways the one of the fewest rounds is
    kept, then that from the first node. A round writes what it reaches, the edges so far that are hops and a
    pointer to where it came from, nothing else; paths are put together when they are asked for. traverse_dirs=False leaves out folders,
    which otherwise bring every item within reach of any anchor. A group is no node of a path: its reader and
    its member follow each other, and of all who lead to a group only the best goes on to its members; no
    reader of a group is one of them.
    """

    def __init__(self, edges: DataFrame, seeds: DataFrame, traverse_dirs: bool = True):
        if not traverse_dirs:
            edges = edges.where("not (src like 'dir:%' or dst like 'dir:%')")
        plain = edges.where(~_grouped())
        both = cut(plain.select("src", "dst", "edge_type").union(plain.select("dst", "src", "edge_type")))
        self.free, self.real = both.where("edge_type = 'contains'").drop("edge_type"), both.where("edge_type <> 'contains'")
        groups = cut(edges.where(_grouped()))
        self.readers = groups.where(F.startswith("dst", F.lit(GROUP))).select("src", F.col("dst").alias("group"), "edge_type")
        self.members = groups.where(F.col("edge_type") == MEMBER).select(F.col("src").alias("group"), "dst")
        start = seeds.groupBy("node").agg(F.min("reason").alias("reason"))
        start = start.select("node", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("prev"), F.lit(None).cast("int").alias("prev_hops"), F.lit(None).cast("string").alias("edge_type"), F.lit(1).alias("n"), F.lit(False).alias("imported"), "reason", F.array().cast("array<string>").alias("types"))
        #: Of each number of hops, what its rounds reached.
        self.levels = [self._closed(start, 0, [])]

    @staticmethod
    def _best(ahead: DataFrame, hops: int) -> DataFrame:
        """Of each node the way from the first node before it."""
        best = ahead.groupBy("node").agg(F.min(F.struct(*_NEXT)).alias("b"))
        return best.select("node", F.lit(hops).alias("hops"), "b.*")

    @staticmethod
    def _new(rows: DataFrame, settled: list[DataFrame]) -> DataFrame:
        for frame in settled:
            rows = rows.join(frame.select("node"), "node", "left_anti")
        return cut(rows)

    def _closed(self, start: DataFrame, hops: int, settled: list[DataFrame]) -> list[DataFrame]:
        """start and what contains edges reach from it, a frame a round, without what is settled, to which no such edge leads from elsewhere.

        Edges run both ways, so those from a round lead to it, to the round before and to the next, and only
        these two are looked at.
        """
        frontier, out = self._new(start, [self._all(settled)] if settled else []), []
        while not frontier.isEmpty():
            out.append(frontier)
            ahead = frontier.join(self.free, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.col("node").alias("prev"), F.col("hops").alias("prev_hops"), F.lit("contains").alias("edge_type"), (F.col("n") + 1).alias("n"), "imported", "reason", "types")
            frontier = self._new(self._best(ahead, hops), out[-2:])
        return out

    @staticmethod
    def _all(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def _hop(self) -> None:
        """Settles the states of one more hop."""
        hops, last = len(self.levels), self.levels[-1]
        if not last:
            self.levels.append([])
            return
        came = self._all(last).select("node", F.col("hops").alias("prev_hops"), (F.col("n") + 1).alias("n"), "imported", "reason", "types")
        ways = came.join(self.real, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.col("node").alias("prev"), "prev_hops", "edge_type", "n", "imported", "reason", "types")
        # what leads to a group is reduced to the best before it goes on: by readers to members, and back
        before = F.min(F.struct(F.col("node").alias("prev"), "prev_hops", "n", "imported", "reason", "types")).alias("b")
        to = came.join(self.readers, F.col("node") == F.col("src")).groupBy("group", "edge_type", "imported").agg(before).select("group", "edge_type", "b.*")
        ways = ways.unionByName(to.join(self.members, "group").select(F.col("dst").alias("node"), "prev", "prev_hops", "edge_type", "n", "imported", "reason", "types"))
        back = came.join(self.members, F.col("node") == F.col("dst")).groupBy("group", "imported").agg(before).select("group", "b.*")
        ways = ways.unionByName(back.join(self.readers, "group").select(F.col("src").alias("node"), "prev", "prev_hops", "edge_type", "n", "imported", "reason", "types"))
        ways = ways.where("node <> prev").withColumns({"imported": F.col("imported") | (F.col("edge_type") == "imports"), "types": F.concat("types", F.array("edge_type"))})
        ways = cut(ways)
        own = self._closed(self._best(ways.where("not imported"), hops), hops, [])
        self.levels.append(own + self._closed(self._best(ways.where("imported"), hops), hops, own))

    def to(self, hops: int) -> Search:
        while len(self.levels) <= hops:
            self._hop()
        return self

    def states(self, hops: int) -> DataFrame | None:
        """All settled states of so many hops at most, None if there are none."""
        frames = [f for level in self.to(hops).levels[: hops + 1] for f in level]
        return self._all(frames) if frames else None

    def paths(self, hops: int) -> DataFrame:
        """Best path to every node within so many hops: node, reason, distance, cost, path, edge_types.

        Paths are put together by doubling: each state's part grows by the part of the state that it points to,
        so the rounds are the logarithm of the longest path.
        """
        states = self.states(hops)
        if states is None:
            return self.free.sparkSession.createDataFrame([], "node string, reason string, distance int, cost int, path array<string>, edge_types array<string>")
        none = F.array().cast("array<string>")
        parts = states.select("node", "hops", F.col("prev").alias("up"), F.col("prev_hops").alias("up_hops"), F.array("node").alias("path"), F.when(F.col("edge_type").isNull(), none).otherwise(F.array("edge_type")).alias("types"))
        longest, reach = states.agg(F.max("n")).first()[0], 1
        while reach < longest:
            upper = parts.select(F.col("node").alias("up"), F.col("hops").alias("up_hops"), F.col("up").alias("_up"), F.col("up_hops").alias("_hops"), F.col("path").alias("_path"), F.col("types").alias("_types"))
            parts = parts.join(upper, ["up", "up_hops"], "left").select("node", "hops", F.col("_up").alias("up"), F.col("_hops").alias("up_hops"), F.concat(F.coalesce("_path", none), "path").alias("path"), F.concat(F.coalesce("_types", none), "types").alias("types"))
            parts, reach = cut(parts), 2 * reach
        one = states.groupBy("node").agg(F.min(F.struct(_cost().alias("cost"), "hops", "reason")).alias("b")).select("node", "b.*")
        return one.join(parts, ["node", "hops"]).select("node", "reason", F.col("hops").alias("distance"), "cost", "path", F.col("types").alias("edge_types"))


    def nearest(self, hops: int) -> DataFrame:
        """Of each item the best path to it within so many hops, as file_paths() of paths() has it, without its nodes: path, target_node, distance, cost, reason, path_types, and least_hops of all paths to it.

        A state knows how long its path is and which edges are its hops, so no path is put together.
        """
        states = self.states(hops)
        if states is None:
            return self.free.sparkSession.createDataFrame([], "path string, target_node string, distance int, cost int, reason string, path_types array<string>, least_hops int")
        rows = states.where(~F.startswith("node", F.lit("dir:"))).select(_owner("node").alias("path"), _cost().alias("cost"), "hops", "n", "node", "reason", "types")
        best = rows.groupBy("path").agg(F.min(F.struct("cost", "hops", "n", "node", "reason", "types")).alias("b"), F.min("hops").alias("least_hops"))
        return best.select("path", F.col("b.node").alias("target_node"), F.col("b.hops").alias("distance"), "b.cost", "b.reason", path_types("b.types").alias("path_types"), "least_hops")

    def traced(self, ends: DataFrame) -> DataFrame:
        """Whole paths to a few settled states (target_node, distance): target_node, distance, nodes, edge_types.

        Goes back a state a round from all of them at once, and writes nothing of the others.
        """
        states, none = self.states(len(self.levels) - 1), F.array().cast("array<string>")
        if states is None:
            return ends.select("target_node", "distance", none.alias("nodes"), none.alias("edge_types")).limit(0)
        back = states.select(F.col("node").alias("up"), F.col("hops").alias("up_hops"), F.col("prev").alias("_up"), F.col("prev_hops").alias("_hops"), "edge_type")
        types = F.col("edge_type").isNotNull()
        live = cut(ends.select("target_node", "distance", F.col("target_node").alias("up"), F.col("distance").alias("up_hops"), none.alias("nodes"), none.alias("edge_types")).distinct())
        done = []
        while not live.isEmpty():
            met = back.join(F.broadcast(live), ["up", "up_hops"])
            met = cut(met.select("target_node", "distance", F.col("_up").alias("up"), F.col("_hops").alias("up_hops"), F.concat(F.array("up"), "nodes").alias("nodes"), F.when(types, F.concat(F.array("edge_type"), "edge_types")).otherwise(F.col("edge_types")).alias("edge_types")))
            done.append(met.where("up is null").drop("up", "up_hops"))
            live = met.where("up is not null")
        return self._all(done) if done else live.drop("up", "up_hops")


def _cost() -> Column:
    """What a state's path costs: by its hops, more with an import."""
    return F.when(F.col("hops") == 0, 0).when(F.col("hops") == 1, F.when(F.col("imported"), 2).otherwise(1)).otherwise(F.when(F.col("imported"), 4).otherwise(3))


def _owner(node: str) -> Column:
    """The path of a node's item: what follows the node's kind; of a symbol without its name, which has no colon."""
    rest = F.expr(f"substring({node}, instr({node}, ':') + 1)")
    return F.when(F.startswith(node, F.lit("symbol:")), F.left(rest, F.length(rest) - F.length(F.substring_index(node, ":", -1)) - 1)).otherwise(rest)


def search(edges: DataFrame, seeds: DataFrame, hops: int = MAX_HOPS, traverse_dirs: bool = True) -> DataFrame:
    """Best path to every node within so many hops; see Search."""
    return Search(edges, seeds, traverse_dirs).paths(hops)


def file_paths(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of each item its best path: of its node's, its kind's and its symbols' the cheapest, nearest, shortest, first."""
    owners = nodes.where("node_type <> 'dir'").select("node", F.col("path").alias("item"))
    rows = found.join(owners, "node")
    best = F.min(F.struct("cost", "distance", F.size("path").alias("n"), "node", "path", "edge_types", "reason"))
    out = rows.groupBy("item").agg(best.alias("b")).select(F.col("item").alias("path"), F.col("b.node").alias("target_node"), "b.distance", "b.cost", F.col("b.path").alias("nodes"), "b.edge_types", "b.reason")
    return out.withColumn("path_types", path_types("edge_types"))


def neighbour_count(found: DataFrame, items: DataFrame) -> int:
    """Contracts and workflows (of items: path, artifact_type) that file_paths() reached in a hop or more."""
    return found.where("distance > 0").join(items.where("artifact_type in ('contract', 'workflow')").select("path"), "path", "left_semi").count()


def explanations(found: DataFrame) -> DataFrame:
    """file_paths() as reported: cut to a few nodes and edges, with the parts of a score."""
    seed, gained = F.lit(60), F.lit(0)
    for reason, bonus in SEED_BONUS.items():
        seed = F.when(F.col("reason") == reason, bonus).otherwise(seed)
    for edge, bonus in PATH_BONUS.items():
        gained = gained + F.when(F.array_contains("path_types", edge), bonus).otherwise(0)
    scores = F.struct(seed.alias("seed_bonus"), gained.alias("path_bonus"), F.col("cost").alias("path_cost"), F.col("distance").alias("semantic_hops"))
    return found.select("path", "target_node", F.slice("nodes", 1, SHOWN_NODES).alias("nodes"), F.slice("edge_types", 1, SHOWN_EDGES).alias("edge_types"), scores.alias("score_breakdown"))
