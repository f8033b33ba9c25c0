"""Class hierarchy (DAG) operators.

Forms used:
  parents   ``(node, parents array)`` – child → parents, ``[-1]`` for a root
  edges     ``(child, pos, parent)`` – the same, exploded; ``parent = -1`` marks a root
  paths     ``(node, depth, n_paths)`` – one row per distinct depth with the number of
            root paths of that length (the reference keeps one list entry per path;
            counting instead of enumerating keeps diamond-rich DAGs linear)

Depth and ancestor closure are iterative joins, one round per hierarchy level;
the driver loop runs over depth, never over rows. Each round's result is
checkpointed into the shared ``spark.checkpoint.dir`` so lineage stays short and
a lost executor recomputes one round only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxolink.operators.ranking import HASH_BYTES, range_count
from taxolink.functions.text import relation_ids
from taxolink.session import write_and_read

ROOT = -1


class HierarchyError(ValueError):
    """Raised when a hierarchy has a cycle reachable from a root (the reference never returns)."""


# ---------------------------------------------------------------- parsing and validity

def parse_parents(catalog: DataFrame, id_col: str, relation_col: str,
                  pattern: str = r"ChildOf:CWE ID:(\d+)") -> DataFrame:
    """H1: parent ids out of a relation text, distinct in order, ``[-1]`` when there are none."""
    return catalog.select(F.col(id_col).alias("node"), relation_ids(relation_col, pattern).alias("parents"))


def keep_valid(parents: DataFrame, valid: DataFrame, valid_col: str = "node") -> DataFrame:
    """Keep nodes that are valid ids, keep only valid parents (in order),
    a node left without parents gets ``[-1]``."""
    ids = valid.select(F.col(valid_col).alias("node")).distinct()
    nodes = parents.join(ids, "node", "left_semi")
    # the outer explode keeps nodes without parents, so no join has to bring them back
    exploded = nodes.select("node", F.posexplode_outer("parents").alias("pos", "parent"))
    known = ids.select(F.col("node").alias("_valid"))
    marked = exploded.join(known, F.col("parent") == F.col("_valid"), "left")
    kept = F.collect_list(F.when(F.col("_valid").isNotNull(), F.struct("pos", "parent")))  # nulls are left out
    lists = marked.groupBy("node").agg(F.transform(F.array_sort(kept), lambda s: s["parent"]).alias("_p"))
    return lists.select("node", F.when(F.size("_p") > 0, F.col("_p"))
                                 .otherwise(F.array(F.lit(ROOT).cast("long"))).alias("parents"))


def edges_of(parents: DataFrame) -> DataFrame:
    """H3: child → parents map as a long edge table ``(child, pos, parent)``."""
    return parents.select(F.col("node").alias("child"), F.posexplode("parents").alias("pos", "parent"))


def roots_of(parents: DataFrame) -> DataFrame:
    """Nodes that list -1 among their parents: roots whatever else they list."""
    return parents.filter(F.array_contains("parents", ROOT)).select("node")


def path_edges(parents: DataFrame) -> DataFrame:
    """Edges that lead towards a root: a node listing -1 is a root, its other edges are dropped
    (the dense child → parents form turns all of its parents into -1)."""
    below = parents.filter(~F.array_contains("parents", ROOT))
    return below.select(F.col("node").alias("child"), F.explode("parents").alias("parent")).distinct()


def problems(parents: DataFrame) -> DataFrame:
    """Report ``(node, problem)``: a parent that is not a node ('missing_parent'), or a node
    that is its own ancestor ('cycle')."""
    e = edges_of(parents).filter(F.col("parent") != ROOT)
    nodes = parents.select(F.col("node").alias("parent"))
    missing = (e.join(nodes, "parent", "left_anti")
                .select(F.col("child").alias("node"), F.lit("missing_parent").alias("problem")))
    clo = ancestors(parents, fail_on_cycle=False)
    cyc = (clo.filter(F.col("node") == F.col("ancestor"))
              .select("node", F.lit("cycle").alias("problem")))
    return missing.unionByName(cyc).distinct()


# ---------------------------------------------------------------- depth, levels, closure

def _materialize(df: DataFrame) -> DataFrame:
    """Write once into the shared checkpoint folder and read back (never a machine-local copy;
    unlike an eager RDD checkpoint the input is computed only once)."""
    return write_and_read(df, "hierarchy")


def depth_paths(parents: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """H4: ``(node, depth, n_paths, mantissa, exponent)``; a root has depth 0; otherwise every path to a root counts.

    Diamonds multiply paths: ``n_paths`` is exact, a DECIMAL(38), and null beyond 38 digits; ``mantissa * 2**exponent`` (mantissa
    from 0.5 to 1) tells the number beyond them too. Rounds: frontier(depth d) ⋈ edges on parent → children at depth d+1 with
    summed path counts. A node only reachable through a missing parent gets no depth (see
    :func:`problems`). A cycle reachable from a root would never end; it raises after
    as many rounds as there are nodes.
    """
    parents = _materialize(parents)
    edges = _materialize(path_edges(parents).filter(F.col("parent") != ROOT))
    frontier = _materialize(roots_of(parents).select(
        "node", F.lit(0).alias("depth"), F.lit(1).cast("decimal(38,0)").alias("n_paths"),
        F.lit(0.5).alias("mantissa"), F.lit(1).alias("exponent")))
    limit = max_rounds if max_rounds is not None else parents.count() + 1
    found = [frontier]
    depth = 0
    while frontier.limit(1).count() > 0:
        depth += 1
        if depth > limit:
            raise HierarchyError(f"hierarchy does not end after {limit} levels: cycle below a root")
        below = frontier.join(edges, frontier.node == edges.parent)
        # mantissas are added at the scale of the child's largest exponent
        top = F.max("exponent").over(Window.partitionBy("child"))
        scaled = F.col("mantissa") * F.pow(F.lit(2.0), F.greatest(F.col("exponent") - F.col("top"), F.lit(-1000)))
        nxt = (below.withColumn("top", top).groupBy(F.col("child").alias("node"))
                    .agg(F.when(F.count("n_paths") == F.count(F.lit(1)), F.try_sum("n_paths")).alias("n_paths"),
                         F.sum(scaled).alias("m"), F.max("top").alias("top")))
        shift = F.floor(F.log2("m")).cast("int") + 1
        nxt = nxt.select("node", F.lit(depth).alias("depth"), F.col("n_paths").cast("decimal(38,0)").alias("n_paths"),
                         (F.col("m") / F.pow(F.lit(2.0), shift)).alias("mantissa"), (F.col("top") + shift).alias("exponent"))
        frontier = _materialize(nxt)
        found.append(frontier)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def depth_lists(paths: DataFrame) -> DataFrame:
    """H4 list form: ``(node, depths)``, the sorted list of a node's depths as run lengths ``(depth, n_paths)``: one entry
    per depth, however many paths there are."""
    return paths.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("depth", "n_paths"))).alias("depths"))


def levels(paths: DataFrame) -> DataFrame:
    """H8: depth → nodes, distinct; a node appears on each level it can be reached at."""
    return paths.select("depth", "node").distinct()


def ancestors(parents: DataFrame, fail_on_cycle: bool = True, max_rounds: int | None = None) -> DataFrame:
    """Ancestor closure ``(node, ancestor)``, distinct, a root has none.

    Semi-naive rounds: new pairs = delta ⋈ edges, minus pairs already known. The
    closure of a finite graph is finite, so this ends on cycles too; with
    ``fail_on_cycle`` a node that becomes its own ancestor raises.
    """
    parents = _materialize(parents)
    edges = _materialize(path_edges(parents).filter(F.col("parent") != ROOT))
    # each round writes its new pairs only; the closure is the union of what the rounds wrote
    delta = closure = _materialize(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")))
    limit = max_rounds if max_rounds is not None else parents.count() + 1
    rounds = 0
    while delta.limit(1).count() > 0:
        rounds += 1
        if rounds > limit:
            raise HierarchyError("closure does not end")
        step = (delta.join(edges, delta.ancestor == edges.child)
                     .select(delta.node, F.col("parent").alias("ancestor")).distinct())
        delta = _materialize(step.join(closure, ["node", "ancestor"], "left_anti"))
        closure = closure.unionByName(delta)
    if fail_on_cycle and closure.filter(F.col("node") == F.col("ancestor")).limit(1).count() > 0:
        raise HierarchyError("cycle in hierarchy")
    return closure


def expand_labels(labels: DataFrame, closure: DataFrame, mask_ids: DataFrame | None = None,
                  id_col: str = "row_id", class_col: str = "class_idx") -> DataFrame:
    """Add every ancestor of each label; labels outside the hierarchy stay alone.
    With ``mask_ids`` only those rows are expanded (rows in any mask).

    Rows are dealt by record into as many tasks as the input's size asks for, and made distinct there only: before the
    shuffle a task would keep in memory whatever its part of the input expands to. The result stays dealt by record."""
    clo = closure.select(F.col("node").alias(class_col), "ancestor")
    target = labels if mask_ids is None else labels.join(mask_ids.select(id_col), id_col, "left_semi")
    up = target.join(clo, class_col).select(id_col, F.col("ancestor").alias(class_col))
    dealt = labels.select(id_col, class_col).unionByName(up).repartition(range_count(labels, HASH_BYTES), id_col)
    return dealt.distinct()


def parent_child_edges(parents: DataFrame) -> DataFrame:
    """H5: parent → children; the parent -1 lists the roots. Every listed edge is kept."""
    return edges_of(parents).select(F.col("parent"), F.col("child"))


def children_of(frontier: DataFrame, parents: DataFrame, node_col: str = "node") -> DataFrame:
    """Children of the frontier nodes (join on the parent → children edges)."""
    pc = parent_child_edges(parents).filter(F.col("parent") != ROOT)
    return frontier.join(pc, frontier[node_col] == pc.parent).drop("parent")


# ---------------------------------------------------------------- dense index forms

def index_edges(parents: DataFrame, index: DataFrame, id_col: str = "node",
                idx_col: str = "class_idx") -> DataFrame:
    """Both edge forms in dense-index space, ``(form, src, dst)``.

    ``child_parent``: a node listing -1 gets -1 for every listed parent; otherwise each
    parent is mapped. ``parent_child``: every listed edge, -1 kept as the root key.
    """
    m = index.select(F.col(id_col).alias("_id"), F.col(idx_col).cast("long").alias("_ix"))
    m = m.unionByName(m.sparkSession.createDataFrame([(ROOT, ROOT)], "_id long, _ix long"))
    e = parents.select(F.col("node").alias("child"), F.array_contains("parents", ROOT).alias("_isroot"),
                       F.posexplode("parents").alias("pos", "parent"))
    child_ix = m.select(F.col("_id").alias("child"), F.col("_ix").alias("src"))
    par_ix = m.select(F.col("_id").alias("parent"), F.col("_ix").alias("_pix"))
    mapped = e.join(child_ix, "child").join(par_ix, "parent")
    cp = mapped.select(F.lit("child_parent").alias("form"), "src", "pos",
                       F.when(F.col("_isroot"), F.lit(ROOT).cast("long")).otherwise(F.col("_pix")).alias("dst"))
    pc = mapped.select(F.lit("parent_child").alias("form"), F.col("_pix").alias("src"), "pos",
                       F.col("src").alias("dst"))
    return cp.unionByName(pc)


# ---------------------------------------------------------------- listing

def graph_listing(parents: DataFrame, names: DataFrame, root_id: int = 1003,
                  prefix: str = "CWE-ID ", root_name: str = "Root Node") -> DataFrame:
    """Node labels ``<prefix><id>:<name>`` plus a synthetic root; edges child → parent,
    or child → synthetic root when the first listed parent is -1 (then no other edge)."""
    spark = parents.sparkSession
    root = spark.createDataFrame([(root_id, root_name)], "node long, name string")
    nodes = names.select(F.col("node").cast("long"), "name").unionByName(root)
    node_rows = nodes.select(F.lit("node").alias("kind"), F.col("node").alias("src"),
                             F.lit(None).cast("long").alias("dst"),
                             F.concat(F.lit(prefix), F.col("node").cast("string"), F.lit(":"), F.col("name")).alias("label"))
    first_root = F.get(F.col("parents"), 0) == ROOT
    to_root = parents.filter(first_root).select(F.col("node").alias("src"), F.lit(root_id).cast("long").alias("dst"))
    to_par = (parents.filter(~first_root)
                     .select(F.col("node").alias("src"), F.explode("parents").alias("dst")))
    edge_rows = (to_root.unionByName(to_par.select("src", F.col("dst").cast("long")))
                        .select(F.lit("edge").alias("kind"), F.col("src").cast("long"), "dst",
                                F.lit(None).cast("string").alias("label")))
    return node_rows.unionByName(edge_rows)
