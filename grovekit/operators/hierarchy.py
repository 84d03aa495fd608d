"""The tree of aggregate entities: clustering, synthesis, lifted relations, checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovekit.functions import text as T
from grovekit.functions.json_repair import community_fields
from grovekit.models import ask
from grovekit.sources.checkpoints import cut as checkpointed

CELL_ROWS = 1000  # rows of a cell, in which a mixture is fitted


def lift_relations(edges: DataFrame, membership: DataFrame, token_budget: int | None = None, summarize: Callable[[str], str] | None = None) -> DataFrame:
    """``a, b, n_edges, description`` of every pair of clusters with relations between their members, either way round.

    Two equi-joins put clusters on an edge's ends, then edges meet by pair: the
    cost is that of the edges, whatever the number of clusters. Descriptions are
    ordered; over ``token_budget`` words ``summarize`` takes their place.
    """
    m = membership.select("entity_name", "cluster")
    both = edges.join(m.select(F.col("entity_name").alias("src"), F.col("cluster").alias("ca")), "src").join(m.select(F.col("entity_name").alias("dst"), F.col("cluster").alias("cb")), "dst")
    line = F.concat(F.lit("relationship<|>"), "src", F.lit("<|>"), "dst", F.lit("<|>"), "description", F.lit(" "))
    rows = both.filter("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), line.alias("line")).distinct()
    out = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_edges"), F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("description"))
    if token_budget is not None and summarize is not None:
        asked = ask(summarize, F.when(T.token_count("description") > token_budget, F.col("description")))
        out = out.withColumn("description", F.coalesce(asked, F.col("description")))
    return out


def inner_relations(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Edges whose ends lie in one cluster."""
    m = membership.select("entity_name", "cluster")
    out = edges.join(m.select(F.col("entity_name").alias("src"), F.col("cluster").alias("cluster")), "src").join(m.select(F.col("entity_name").alias("dst"), F.col("cluster").alias("__c")), "dst")
    return out.filter("cluster = __c").drop("__c")


def members(nodes: DataFrame) -> DataFrame:
    """``cluster, n, children, source_id``: names in order and the distinct source ids of each cluster's members."""
    return nodes.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("entity_name")).alias("children"), F.array_join(F.array_sort(F.collect_set("source_id")), "|").alias("source_id"))


def pack_cluster(nodes: DataFrame, edges: DataFrame, max_tokens: int = 12_000) -> DataFrame:
    """``cluster, context``: entity and relation tables within half the budget each, for a model to name the cluster by.

    Entities come by degree, relations by description downwards.
    """
    def table(rows: DataFrame, order: list, fields: list[str], title: str) -> DataFrame:
        w = Window.partitionBy("cluster").orderBy(*order)
        cost = F.sum(T.token_count("description")).over(w.rowsBetween(Window.unboundedPreceding, 0))
        kept = rows.withColumn("i", F.row_number().over(w) - 1).withColumn("__c", cost).filter(F.col("__c") <= max_tokens // 2)
        line = F.concat_ws(",\t", "i", *[T.quoted(F.coalesce(F.col(f).cast("string"), F.lit("UNKNOWN"))) for f in fields])
        return kept.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("l")))), lambda x: x["l"]), "\n").alias(title))

    n = table(nodes, [F.desc("degree"), "entity_name"], ["entity_name", "entity_type", "description", "degree"], "entities")
    e = table(edges, [F.desc("description"), "src", "dst"], ["src", "dst", "description"], "relations")
    return n.join(e, "cluster", "left").select("cluster", F.concat_ws("\n\n", "entities", "relations").alias("context"))


class Mixture:
    """Gaussian mixture with full covariances, by expectation maximisation from a seeded k-means++ start."""

    def __init__(self, x: np.ndarray, k: int, seed: int = 224, rounds: int = 60, starts: int = 3):
        best = None
        for s in range(starts):
            self._fit(x, k, np.random.default_rng(seed + s), rounds)
            if best is None or self.likelihood > best[0]:
                best = (self.likelihood, self.weights, self.means, self.covs)
        self.likelihood, self.weights, self.means, self.covs = best
        d = x.shape[1]
        free = (k - 1) + k * d + k * d * (d + 1) / 2
        self.bic = -2 * self.likelihood + free * np.log(len(x))

    def _fit(self, x: np.ndarray, k: int, rng: np.random.Generator, rounds: int) -> None:
        n, d = x.shape
        centres = [x[rng.integers(n)]]
        for _ in range(k - 1):
            gap = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)
            centres.append(x[rng.choice(n, p=gap / gap.sum())] if gap.sum() > 0 else x[rng.integers(n)])
        self.means, self.weights = np.array(centres), np.full(k, 1 / k)
        self.covs = np.array([np.cov(x.T).reshape(d, d) + 1e-6 * np.eye(d)] * k)
        last = -np.inf
        for _ in range(rounds):
            log_p = self._log(x)
            top = log_p.max(1, keepdims=True)
            total = top[:, 0] + np.log(np.exp(log_p - top).sum(1))
            self.likelihood = float(total.sum())
            r = np.exp(log_p - total[:, None])
            mass = r.sum(0) + 1e-10
            self.weights, self.means = mass / n, (r.T @ x) / mass[:, None]
            for j in range(k):
                y = x - self.means[j]
                self.covs[j] = (r[:, j, None] * y).T @ y / mass[j] + 1e-6 * np.eye(d)
            if abs(self.likelihood - last) < 1e-3 * max(1.0, abs(last)):
                break
            last = self.likelihood

    def _log(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.means)))
        for j, (m, c) in enumerate(zip(self.means, self.covs, strict=True)):
            y = np.linalg.solve(np.linalg.cholesky(c), (x - m).T)
            out[:, j] = np.log(self.weights[j] + 1e-300) - 0.5 * ((y**2).sum(0) + x.shape[1] * np.log(2 * np.pi) + np.linalg.slogdet(c)[1])
        return out

    def assign(self, x: np.ndarray) -> np.ndarray:
        return self._log(x).argmax(1)


def best_k(x: np.ndarray, most: int = 50, tolerance: float = 1e-3, seed: int = 224) -> int:
    """Number of components of least BIC; the sweep ends when the criterion hardly changes."""
    best, last, out = np.inf, None, 1
    for k in range(1, max(2, min(len(x), most))):
        bic = Mixture(x, k, seed, starts=1).bic
        if bic < best:
            best, out = bic, k
        if last is not None and abs(bic - last) < tolerance * abs(last):
            break
        last = bic
    return out


def principal_axes(nodes: DataFrame, dims: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Mean and first principal axes of the unit vectors of all rows (in place of a random manifold embedding).

    Tasks send sums and products of their rows alone, of the vectors' width.
    """
    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, one, two = 0, 0.0, 0.0
        for p in parts:
            if len(p):
                x = _unit(p["embedding"])
                n, one, two = n + len(x), one + x.sum(0), two + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "one": [one.tolist()], "two": [two.ravel().tolist()]})

    rows = nodes.select("embedding").mapInPandas(sums, "n long, one array<double>, two array<double>").orderBy("n", "one").collect()
    n, one = sum(r.n for r in rows), sum(np.array(r.one) for r in rows)
    mean = one / n
    spread = sum(np.array(r.two) for r in rows).reshape(len(mean), -1) / n - np.outer(mean, mean)
    _, axes = np.linalg.eigh(spread)
    axes = axes[:, ::-1][:, : max(1, min(dims, n - 2))]
    return mean, axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1, 1)  # a sign that doesn't hang on the machine


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cluster_layer(nodes: DataFrame, cluster_size: int = 20, id_col: str = "entity_name", seed: int = 224, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``entity_name, cluster`` of every node: a Gaussian mixture whose number of components comes from its size and the criterion.

    Vectors are projected on the principal axes of all rows. A layer of more than
    ``cell_rows`` rows is cut into cells of about that many, by quantiles of the
    first axis and of the second within them; rows that quantiles can't part are
    parted by hash. Every cell has a mixture of its own, fitted on all its rows
    in one task. Nothing is sampled, and the method is the same at every size.
    """
    n = nodes.count()
    if n < 3:
        return nodes.select(id_col, F.lit(0).cast("long").alias("cluster"))
    mean, axes = principal_axes(nodes)

    @F.pandas_udf("array<double>")
    def project(s: pd.Series) -> pd.Series:
        return pd.Series(list((_unit(s) - mean) @ axes))

    low = checkpointed(nodes.select(id_col, project("embedding").alias("y")).select(id_col, F.get("y", F.lit(0)).alias("x"), F.coalesce(F.get("y", F.lit(1)), F.lit(0.0)).alias("y")))
    side = int(np.ceil(np.sqrt(n / cell_rows)))
    steps = F.array(*[F.lit((i + 1) / side) for i in range(side - 1)])

    def cell_of(rows: DataFrame, part: list[str], axis: str, name: str) -> DataFrame:
        if side == 1:
            return rows.withColumn(name, F.lit(0))
        edges = rows.groupBy(*part).agg(F.percentile_approx(axis, steps, 10_000).alias("__e"))
        joined = rows.join(F.broadcast(edges), part) if part else rows.join(F.broadcast(edges), F.lit(True))  # one row
        return joined.withColumn(name, F.size(F.filter("__e", lambda e: e < F.col(axis)))).drop("__e")

    cells = cell_of(cell_of(low, [], "x", "i"), ["i"], "y", "j")
    wide = cells.groupBy("i", "j").agg(F.ceil(F.count(F.lit(1)) / (2.0 * cell_rows)).cast("long").alias("deals")).filter("deals > 1")
    cells = cells.join(F.broadcast(wide), ["i", "j"], "left").withColumn("k", F.coalesce(F.pmod(F.xxhash64(id_col), F.col("deals")), F.lit(0)))
    kind = nodes.schema[id_col].dataType.simpleString()

    def fit(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(id_col)
        x = p[["x", "y"]].to_numpy()
        k = min(max(len(x) // cluster_size, best_k(x, seed=seed) if len(x) > 2 else 1), len(x))
        label = Mixture(x, k, seed).assign(x) if k > 1 else np.zeros(len(x), int)
        return pd.DataFrame({id_col: p[id_col], "i": key[0], "j": key[1], "k": key[2], "label": label})

    found = cells.groupBy("i", "j", "k").applyInPandas(fit, f"{id_col} {kind}, i int, j int, k long, label int")
    return found.select(id_col, ((F.col("i").cast("long") * side + F.col("j")) * (1 << 36) + F.col("k") * 4 * cell_rows + F.col("label")).alias("cluster"))


def synthesize(nodes: DataFrame, edges: DataFrame, layer: int, model: Callable[[str], str]) -> tuple[DataFrame, DataFrame]:
    """Next layer's nodes and the reports of a clustered layer.

    A cluster of one passes through as it is; of others the model gives name,
    description and findings, or else they get a name by layer and label and
    their members' descriptions.
    """
    grouped = members(nodes).join(pack_cluster(nodes, inner_relations(edges, nodes)), "cluster")
    texts = nodes.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entity_name", "description"))), lambda x: x["description"]), " | ").alias("texts"), F.min("description").alias("one"))
    rows = grouped.join(texts, "cluster")
    fallback = F.format_string("aggregate_layer_%d_label_%d", F.lit(layer), F.col("cluster"))  # fixed value: form of the name
    said = rows.withColumn("answer", ask(model, F.when(F.col("n") > 1, F.col("context"))))
    name, description, findings = community_fields("answer", fallback, T.truncate_tokens("texts", 256))
    single = F.col("n") == 1
    named = said.select(
        "cluster", "n", "children", "source_id", F.when(single, F.get("children", F.lit(0))).otherwise(name).alias("entity_name"), F.when(single, F.col("one")).otherwise(description).alias("description"), findings.alias("findings"),
    )
    up = named.select("cluster", "entity_name", "description", "source_id", F.lit(1).alias("degree"), F.lit("AGGREGATE").alias("entity_type"))
    reports = named.filter(~single).select("entity_name", F.col("description").alias("entity_description"), "findings", F.lit(layer + 1).alias("level"), "children", "source_id", "cluster")
    return up, reports


def build_tree(entities: DataFrame, relations: DataFrame, embed: Callable[[DataFrame], DataFrame], model: Callable[[str], str] = lambda prompt: "", cluster_size: int = 20, max_layers: int | None = None, cut: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leveled nodes with parents, lifted relations and reports.

    Layers shrink about ``cluster_size`` times, so the driver's loop is as deep
    as the logarithm of the input; each layer is written to the checkpoint
    folder. The last layer hangs on one root.
    """
    cut = cut or (lambda df: df.checkpoint())
    layer = cut(embed(entities.select("entity_name", "entity_type", "description", "source_id", "degree")))
    n = layer.count()
    depth = max_layers or int(np.round(np.log(max(n, 2)) / np.log(cluster_size))) + 1
    edges = cut(relations.select("src", "dst", "description"))
    nodes, lifted, reports = None, None, None
    join = lambda a, b: b if a is None else a.unionByName(b)
    for level in range(depth):
        if n <= 2:
            break
        labels = cluster_layer(layer, cluster_size)
        clustered = cut(layer.join(labels, "entity_name"))
        if clustered.select("cluster").distinct().count() <= 4:
            break
        up, own = synthesize(clustered, edges, level, model)
        up = cut(up)
        parents = up.select("cluster", F.col("entity_name").alias("parent"))
        nodes = join(nodes, clustered.join(parents, "cluster").select("entity_name", "description", "source_id", "degree", F.lit(level).alias("level"), "parent"))
        reports = join(reports, own.drop("cluster"))
        named = clustered.select("entity_name", "cluster").join(parents, "cluster").select("entity_name", F.col("parent").alias("cluster"))
        raised = cut(lift_relations(edges, named).select(F.col("a").alias("src"), F.col("b").alias("dst"), "description", F.lit(1).alias("weight"), F.lit(level + 1).alias("level")))
        lifted = join(lifted, raised)
        edges = raised.select("src", "dst", "description")
        layer = cut(embed(up.drop("cluster").dropDuplicates(["entity_name"])))
        n = layer.count()
    level = depth if nodes is None else nodes.agg(F.max("level")).first()[0] + 1
    level = 0 if nodes is None else level
    last = layer.select("entity_name", "description", "source_id", "degree", F.lit(level).alias("level"), F.lit("root").alias("parent"))
    if n > 1:
        root = last.groupBy().agg(F.lit("aggregate_root").alias("entity_name"), T.truncate_tokens(F.array_join(F.array_sort(F.collect_list("description")), " | "), 256).alias("description"), F.array_join(F.array_sort(F.collect_set("source_id")), "|").alias("source_id"))
        last = last.withColumn("parent", F.lit("aggregate_root")).unionByName(root.select("entity_name", "description", "source_id", F.lit(1).alias("degree"), F.lit(level + 1).alias("level"), F.lit("root").alias("parent")))
    return join(nodes, last), lifted, reports


def orphans(nodes: DataFrame, root: str = "root") -> DataFrame:
    """Nodes whose parent is missing one level up; a sound tree has none."""
    above = nodes.select(F.col("entity_name").alias("parent"), (F.col("level") - 1).alias("level"))
    return nodes.filter(F.col("parent") != root).join(above, ["parent", "level"], "left_anti")


def flat_tree(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lightweight build: every node under the root, relations of level 0 and one report."""
    nodes = entities.withColumn("level", F.lit(0)).withColumn("parent", F.lit("root"))
    rels = relations.withColumn("level", F.lit(0))
    report = entities.groupBy().agg(F.lit("root").alias("entity_name"), F.concat(F.count(F.lit(1)).cast("string"), F.lit(" entities")).alias("entity_description"))
    return nodes, rels, report


def store_relations(relations: DataFrame, longest: int = 190) -> DataFrame:
    """Relations whose names are short enough for the store, at level 0."""
    return relations.filter((F.length("src") <= longest) & (F.length("dst") <= longest)).withColumn("level", F.lit(0))


def number_nodes(nodes: DataFrame) -> DataFrame:
    """A running ``id`` over levels, without moving all rows to one task: counts by level and name prefix come first."""
    key = F.xxhash64("level", "entity_name")
    bucket = F.pmod(key, F.lit(1024))
    rows = nodes.withColumn("__b", bucket)
    w = Window.partitionBy("level", "__b").orderBy("entity_name")
    counts = rows.groupBy("level", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__off", F.sum("__n").over(Window.orderBy("level", "__b").rowsBetween(Window.unboundedPreceding, -1)))
    return rows.withColumn("__i", F.row_number().over(w) - 1).join(F.broadcast(before.drop("__n")), ["level", "__b"]).withColumn("id", F.coalesce("__off", F.lit(0)) + F.col("__i")).drop("__b", "__i", "__off")


def concepts(nodes: DataFrame, communities: DataFrame) -> DataFrame:
    """Nodes that have a report of their own."""
    return nodes.join(communities.select("entity_name").distinct(), "entity_name", "left_semi")
