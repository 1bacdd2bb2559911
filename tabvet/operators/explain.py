"""Explanations.

* E1 TreeSHAP: exact path-dependent TreeSHAP for Spark ML forests. Node
  tables come from the saved model (one row per node); each leaf path is
  turned into merged per-feature intervals and the SHAP polynomial is
  evaluated for many leaves and rows at once with numpy inside
  ``mapInPandas``. Each task emits partial sums; one small aggregate
  finishes the mean |SHAP|.
* E3 permutation importance on source columns: rows are ranked once, a
  bijection of ranks deals a column's values to other rows, and one grouped
  aggregate scores all copies.
* E4/E5 map encoded names to source columns and fold scores.
* E6 picks the method and degrades without raising.
"""
from __future__ import annotations

import logging
import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from tabvet.functions import constants as K
from tabvet.functions.bijection import deal
from tabvet.functions.exprs import snapped
from tabvet.session import scratch_path, ship_package

LOG = logging.getLogger(__name__)


# -------------------------------------------------------------------- E2
def shap_budget(nodes: Column) -> tuple[Column, Column]:
    """E2 as column expressions: (rows, method)."""
    rows = F.when(nodes <= 0, F.lit(K.MAX_SHAP_ROWS)).otherwise(
        F.least(F.greatest(F.floor(F.lit(K.SHAP_ROW_NODE_BUDGET) / nodes), F.lit(K.MIN_SHAP_ROWS)),
                F.lit(K.MAX_SHAP_ROWS)))
    method = F.when(nodes > K.SHAP_MAX_MODEL_NODES, "permutation").otherwise("shap")
    return rows.cast("long"), method


# -------------------------------------------------------------------- tree tables
@dataclass
class LeafGroup:
    """Leaves whose paths have ``k`` distinct features."""
    feat: np.ndarray   # (n, k) feature index per slot
    lo: np.ndarray     # (n, k) x must be > lo
    hi: np.ndarray     # (n, k) x must be <= hi
    z: np.ndarray      # (n, k) cover fraction
    value: np.ndarray  # (n, C) leaf value (already divided by the number of trees)


#: Nodes of the trees of one block, about: what is built in one task and broadcast at once.
BLOCK_NODES = 200_000


def _tree(rows: pd.DataFrame, classification: bool) -> dict:
    """Arrays of one tree from its rows of the node table."""
    n = int(rows["id"].max()) + 1
    left, right, feat = (np.full(n, -1, dtype=np.int64) for _ in range(3))
    thr, cover, values = np.zeros(n), np.zeros(n), [None] * n
    for r in rows.itertuples(index=False):
        i, stats = int(r.id), np.asarray(r.impurityStats, dtype=float)
        left[i], right[i] = int(r.leftChild), int(r.rightChild)
        if classification:
            cover[i] = stats.sum()
            values[i] = stats / stats.sum() if stats.sum() > 0 else stats
        else:
            cover[i] = stats[0] if len(stats) else float(r.rawCount)
            values[i] = np.array([float(r.prediction)])
        if left[i] >= 0:
            feat[i], thr[i] = int(r.feature), float(r.threshold)
    return {"left": left, "right": right, "feat": feat, "thr": thr, "cover": cover, "values": values}


def node_table(model) -> DataFrame:
    """One row per node of a saved forest."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "forest")
    model.write().save(path)
    return spark.read.parquet(path + "/data").select(
        "treeID", "nodeData.id", "nodeData.leftChild", "nodeData.rightChild", "nodeData.prediction",
        "nodeData.impurityStats", "nodeData.rawCount", F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"))


def told_apart(x: Column, nodes: DataFrame, n_features: int) -> Column:
    """The vectors ``x`` with each value replaced by the least of the forest's
    thresholds that it doesn't exceed (else infinity): all trees send both the
    same way, so SHAP values are the same. A feature has fewer thresholds than
    the forest has bins."""
    splits = nodes.where("leftChild >= 0").groupBy("feature").agg(F.sort_array(F.collect_set("threshold")).alias("t"))
    cuts = {r["feature"]: list(r["t"]) for r in splits.collect()}
    return F.array(*[snapped(x[i], cuts.get(i, []), cuts.get(i, []) + [float("inf")]) for i in range(n_features)])


def forest_blocks(model, classification: bool, block_nodes: int = BLOCK_NODES, nodes: DataFrame | None = None) -> tuple[DataFrame, int, int]:
    """``(block, payload)``: the leaf paths of each block of trees, built in
    tasks from the saved model's node table; number of blocks; total nodes."""
    nodes = nodes if nodes is not None else node_table(model)
    spark = nodes.sparkSession
    ship_package(spark)
    n_trees, total = len(model.treeWeights), int(model.totalNumNodes)
    per_block = max(1, n_trees * block_nodes // max(1, total))
    nodes = nodes.withColumn("block", F.floor(F.col("treeID") / per_block).cast("int"))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        paths = leaf_groups([_tree(t, classification) for _, t in rows.groupby("treeID")], n_trees)
        return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "payload": [pickle.dumps(paths)]})

    written = scratch_path(spark, "forest-blocks")
    nodes.groupBy("block").applyInPandas(build, "block int, payload binary").write.parquet(written)
    return spark.read.parquet(written), -(-n_trees // per_block), total


def block_paths(blocks: DataFrame, block: int) -> tuple[list[LeafGroup], np.ndarray]:
    """Leaf paths and expected value of one block: the part of the forest that the driver holds."""
    return pickle.loads(bytes(blocks.where(F.col("block") == block).first()["payload"]))


def leaf_groups(trees: list[dict], n_trees: int | None = None) -> tuple[list[LeafGroup], np.ndarray]:
    """Every leaf path as merged per-feature intervals, grouped by length;
    also the expected value of the forest (cover-weighted)."""
    n_trees = n_trees or len(trees)
    by_k: dict[int, list] = {}
    expected = None
    for t in trees:
        stack = [(0, {}, 1.0)]
        while stack:
            node, path, wz = stack.pop()
            if t["left"][node] < 0:
                v = t["values"][node] / n_trees
                expected = v * wz if expected is None else expected + v * wz
                feats = sorted(path)
                by_k.setdefault(len(feats), []).append(
                    ([f for f in feats], [path[f][0] for f in feats], [path[f][1] for f in feats],
                     [path[f][2] for f in feats], v))
                continue
            f, thr = int(t["feat"][node]), float(t["thr"][node])
            pc = t["cover"][node]
            for child, is_left in ((t["left"][node], True), (t["right"][node], False)):
                frac = t["cover"][child] / pc if pc > 0 else 0.0
                lo, hi, z = path.get(f, (-np.inf, np.inf, 1.0))
                if is_left:
                    hi = min(hi, thr)
                else:
                    lo = max(lo, thr)
                new = dict(path)
                new[f] = (lo, hi, z * frac)
                stack.append((child, new, wz * frac))
    groups = []
    for k, items in sorted(by_k.items()):
        feat = np.array([it[0] for it in items], dtype=np.int64).reshape(len(items), k)
        lo = np.array([it[1] for it in items], dtype=float).reshape(len(items), k)
        hi = np.array([it[2] for it in items], dtype=float).reshape(len(items), k)
        z = np.array([it[3] for it in items], dtype=float).reshape(len(items), k)
        value = np.stack([it[4] for it in items])
        groups.append(LeafGroup(feat, lo, hi, z, value))
    return groups, expected


def shap_values(x: np.ndarray, groups: list[LeafGroup], n_features: int, chunk: int = 4096) -> np.ndarray:
    """Exact path-dependent TreeSHAP for rows ``x`` (R, n_features):
    returns (R, n_features, C)."""
    r_count = x.shape[0]
    n_classes = groups[0].value.shape[1] if groups else 1
    phi = np.zeros((r_count, n_features, n_classes))
    rows_idx = np.arange(r_count)[:, None]
    for g in groups:
        k = g.feat.shape[1]
        if k == 0:
            continue
        for s in range(0, g.feat.shape[0], chunk):
            feat, lo, hi = g.feat[s:s + chunk], g.lo[s:s + chunk], g.hi[s:s + chunk]
            z, val = g.z[s:s + chunk], g.value[s:s + chunk]
            xv = x[:, feat]                                   # (R, n, k)
            o = ((xv > lo) & (xv <= hi)).astype(float)        # one fractions
            w = np.zeros((k + 1,) + o.shape[:2])
            w[0] = 1.0
            for d in range(1, k + 1):                         # extend
                od, zd = o[:, :, d - 1], z[None, :, d - 1]
                w[d] = 0.0
                for i in range(d - 1, -1, -1):
                    w[i + 1] += od * w[i] * (i + 1) / (d + 1)
                    w[i] = zd * w[i] * (d - i) / (d + 1)
            for e in range(1, k + 1):                         # unwound sums
                oe, ze = o[:, :, e - 1], z[None, :, e - 1]
                safe_o = np.where(oe != 0, oe, 1.0)
                nxt = w[k].copy()
                tot_one = np.zeros_like(nxt)
                tot_zero = np.zeros_like(nxt)
                for j in range(k - 1, -1, -1):
                    tmp = nxt / ((j + 1) * safe_o)
                    tot_one += tmp
                    nxt = w[j] - tmp * ze * (k - j)
                    den = np.broadcast_to(ze * (k - j), w[j].shape)
                    tot_zero += np.divide(w[j], den, out=np.zeros_like(w[j]), where=(den != 0))
                wsum = np.where(oe != 0, tot_one, tot_zero) * (k + 1)
                contrib = (wsum * (oe - ze))[:, :, None] * val[None, :, :]   # (R, n, C)
                np.add.at(phi, (rows_idx, feat[None, :, e - 1]), contrib)
    return phi


def tree_shap(model, test_vec: DataFrame, encoded: list[str], classification: bool,
              positive_index: int = 1, max_rows: int | None = None, key: str | None = None,
              block_nodes: int = BLOCK_NODES) -> tuple[DataFrame, int, int]:
    """Mean |SHAP| per encoded feature over the explained rows: all of
    them, unless a ``max_rows`` budget is asked for. Rows that no tree tells
    apart are explained once and weighted by their count. Trees are taken in
    blocks of about ``block_nodes`` nodes, whose leaf paths alone are broadcast;
    a row's values of several blocks are added up before their size is taken.

    Returns ``(scores DataFrame(encoded, importance), rows_explained,
    total_nodes)``. Binary classifiers explain the positive class; with more
    classes the mean over classes of |SHAP| is used.
    """
    spark = test_vec.sparkSession
    table, n_features = node_table(model), len(encoded)
    blocks, n_blocks, nodes = forest_blocks(model, classification, block_nodes, table)
    n_classes = int(model.numClasses) if classification else 1
    rows = test_vec
    if max_rows is not None:
        order = F.md5(F.col(key).cast("string")) if key else F.md5(F.to_json(F.col("features")))
        rows = test_vec.withColumn("_o", order).orderBy("_o").limit(max_rows).drop("_o")
    x = rows.select(vector_to_array("features").alias("x")).select(told_apart(F.col("x"), table, n_features).alias("x"))
    # Few rows may be left, and each is costly: all cores share them.
    arr = x.groupBy("x").agg(F.count(F.lit(1)).alias("w")).repartition(4 * spark.sparkContext.defaultParallelism)
    if n_blocks > 1:  # every block adds to the same rows
        path = scratch_path(spark, "shap-rows")
        arr.withColumn("i", F.monotonically_increasing_id()).write.parquet(path)
        arr = spark.read.parquet(path)

    def phis(groups, pdf):
        x = np.stack(pdf["x"].to_numpy()).astype(float)
        for s in range(0, len(x), 128):
            yield s, shap_values(x[s:s + 128], groups, n_features)

    def strength(phi: np.ndarray) -> np.ndarray:
        """|SHAP| of each row and feature: of the positive class, the mean over classes, or the one value."""
        if classification and n_classes == 2:
            return np.abs(phi[:, :, positive_index])
        return np.abs(phi).mean(axis=2)

    def summed(total, count):
        return pd.DataFrame({"idx": np.arange(n_features), "s": total, "n": np.full(n_features, count)})

    def whole(shared):
        def run(batches):
            total, count = np.zeros(n_features), 0
            for pdf in batches:
                w = pdf["w"].to_numpy()
                for s, phi in phis(shared.value, pdf) if len(pdf) else ():
                    total += w[s:s + 128] @ strength(phi)
                    count += int(w[s:s + 128].sum())
            yield summed(total, count)
        return run

    def part(shared):
        def run(batches):
            for pdf in batches:
                for s, phi in phis(shared.value, pdf) if len(pdf) else ():
                    yield pd.DataFrame({"i": pdf["i"].to_numpy()[s:s + 128], "w": pdf["w"].to_numpy()[s:s + 128], "phi": list(phi.reshape(len(phi), -1))})
        return run

    def added(batches):
        """Rows come sorted: the parts of a row are added up before its strength is taken."""
        total, count, at, weight, phi = np.zeros(n_features), 0, None, 0, None
        for pdf in batches:
            for i, w, p in zip(pdf["i"], pdf["w"], pdf["phi"], strict=True):
                if i == at:
                    phi = phi + np.asarray(p)
                    continue
                if at is not None:
                    total += weight * strength(phi.reshape(1, n_features, -1))[0]
                    count += weight
                at, weight, phi = i, int(w), np.asarray(p)
        if at is not None:
            total += weight * strength(phi.reshape(1, n_features, -1))[0]
            count += weight
        yield summed(total, count)

    schema = "idx long, s double, n long"
    if n_blocks == 1:
        partial = arr.mapInPandas(whole(spark.sparkContext.broadcast(block_paths(blocks, 0)[0])), schema)
    else:
        path = scratch_path(spark, "shap-parts")
        for k in range(n_blocks):
            shared = spark.sparkContext.broadcast(block_paths(blocks, k)[0])
            arr.mapInPandas(part(shared), "i long, w long, phi array<double>").write.mode("append").parquet(path)
            shared.destroy()
        partial = spark.read.parquet(path).repartition("i").sortWithinPartitions("i").mapInPandas(added, schema)
    names = spark.createDataFrame([(i, e) for i, e in enumerate(encoded)], "idx long, encoded string")
    agg = partial.groupBy("idx").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    scores = (agg.join(F.broadcast(names), "idx")
              .select("encoded", (F.col("s") / F.col("n")).alias("importance")))
    n_rows = rows.count()
    return scores, n_rows, nodes


def shap_local_accuracy(model, x: np.ndarray, classification: bool, positive_index: int = 1):
    """Sum of SHAP values plus the expected value, per row (for tests)."""
    blocks, n_blocks, _ = forest_blocks(model, classification)
    parts = [block_paths(blocks, k) for k in range(n_blocks)]
    phi, expected = sum(shap_values(x, groups, x.shape[1]) for groups, _ in parts), sum(e for _, e in parts)
    idx = positive_index if classification else 0
    return phi[:, :, idx].sum(axis=1) + expected[idx]


# -------------------------------------------------------------------- E3
def ranked_rows(df: DataFrame, key: str, seed: int, n_rows: int, rows_per_task: int = 200_000) -> DataFrame:
    """``df`` with ``_rank``, each row's place (from 0) in a seeded order of its
    ``key``; written, so that all later reads see the same. Hash ranges cut
    the ranking into tasks; their number doesn't change the result."""
    ranges = -(-n_rows // rows_per_task) or 1
    h = F.md5(F.concat_ws("|", F.col(f"`{key}`").cast("string"), F.lit(f"rank{seed}")))
    at = (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") * ranges / float(1 << 32)).cast("int")
    rows = df.withColumn("_h", h).withColumn("_r", at)
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = rows.groupBy("_r").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_r").alias("_q"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    inside = F.row_number().over(Window.partitionBy("_r").orderBy("_h", key)) - 1
    out = rows.withColumn("_i", inside).join(F.broadcast(starts), F.col("_r") == F.col("_q")).withColumn("_rank", F.col("_i") + F.col("_s"))
    path = scratch_path(df.sparkSession, "ranked")
    out.drop("_h", "_r", "_q", "_s", "_i").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def permuted(df: DataFrame, numeric: list[str], categorical: list[str], key: str, repeats: int, seed: int,
             n_rows: int, rows_per_task: int = 200_000) -> DataFrame:
    """Every row once per (``_feature``, ``_repeat``), with that feature's
    column permuted over all rows. ``key`` should be distinct. Numeric columns
    become doubles.

    Rows are ranked once. A bijection of the ranks for each feature and repeat
    names the row that a value goes to, so only (rank, value) moves; the wide
    rows meet their new values in one join and are copied in place.
    """
    sources = numeric + categorical
    ship_package(df.sparkSession)
    ranked = ranked_rows(df, key, seed, n_rows, rows_per_task)

    @arrow_udf(LongType())
    def dealt(ranks: pa.Array, features: pa.Array, repeat: pa.Array) -> pa.Array:
        keys = (features.to_numpy(zero_copy_only=False).astype(np.int64) * repeats + repeat.to_numpy(zero_copy_only=False)) * 1_000_003 + seed
        return pa.array(deal(ranks.to_numpy(zero_copy_only=False), n_rows, keys))

    values = [F.struct(F.lit(i).alias("f"), F.col(f"`{c}`").cast("double").alias("num") if c in numeric else F.lit(None).cast("double").alias("num"),
                       F.lit(None).cast("string").alias("text") if c in numeric else F.col(f"`{c}`").cast("string").alias("text"))
              for i, c in enumerate(sources)]
    moved = (ranked.select("_rank", F.inline(F.array(*values))).withColumn("r", F.explode(F.array(*map(F.lit, range(repeats)))))
             .select(dealt("_rank", "f", "r").alias("_to"), F.struct("f", "r", "num", "text").alias("v")))
    received = moved.groupBy("_to").agg(F.collect_list("v").alias("_values"))  # features x repeats values for a row
    copies = ranked.join(received, F.col("_rank") == F.col("_to")).withColumn("_v", F.explode("_values")).drop("_values", "_to", "_rank")
    mine = F.col("_v.f")
    swapped = [F.when(mine == i, F.col("_v.num")).otherwise(F.col(f"`{c}`").cast("double")).alias(c) if c in numeric else
               F.when(mine == i, F.col("_v.text")).otherwise(F.col(f"`{c}`").cast("string")).alias(c) for i, c in enumerate(sources)]
    return copies.select(*[F.col(f"`{c}`") for c in df.columns if c not in sources], *swapped,
                         F.get(F.array(*map(F.lit, sources)), mine).alias("_feature"), F.col("_v.r").alias("_repeat"))


def permutation_importance(model, prep, test_vec: DataFrame, key: str, classification: bool,
                           repeats: int = K.PERMUTATION_REPEATS, seed: int = 42) -> DataFrame:
    """Mean drop of the estimator score (accuracy / R²) when each source
    column is shuffled, clipped at 0 ``(feature, importance)``."""
    sources = prep.numeric + prep.categorical
    base = test_vec.select(key, "label", *[F.col(f"`{c}`") for c in sources])
    as_is = base.withColumn("_feature", F.lit(None).cast("string")).withColumn("_repeat", F.lit(-1))
    replicas = permuted(base, prep.numeric, prep.categorical, key, repeats, seed, base.count()).unionByName(as_is)
    pred = model.transform(prep.transform(replicas, [key, "label", "_feature", "_repeat"]))
    if classification:
        scores = pred.groupBy("_feature", "_repeat").agg(
            F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("score"))
    else:
        scores = pred.groupBy("_feature", "_repeat").agg(
            (1 - F.sum((F.col("label") - F.col("prediction")) ** 2)
             / (F.var_pop("label") * F.count(F.lit(1)))).alias("score"))
    baseline = scores.where(F.col("_feature").isNull()).select(F.col("score").alias("baseline"))
    return (scores.where(F.col("_feature").isNotNull()).crossJoin(baseline)
            .groupBy(F.col("_feature").alias("feature"))
            .agg(F.greatest(F.avg(F.col("baseline") - F.col("score")), F.lit(0.0)).alias("importance")))


# -------------------------------------------------------------------- E4
INDICATOR = "^(?:missingindicator_|missing:)"


def source_column(encoded: Column, numeric: list[str], categorical: list[str]) -> Column:
    """E4 for name-only inputs: the column an encoded name comes from. Missing
    indicators stay apart from the column they describe; of several
    categorical columns that a one-hot name could start with, the longest owns it."""
    name = F.regexp_replace(encoded, "^(?:num|cat|remainder)__", "")
    names = lambda columns: F.array(*map(F.lit, columns)).cast("array<string>")
    owners = F.filter(names(categorical), lambda c: F.startswith(name, F.concat(c, F.lit("_"))) | F.startswith(name, F.concat(c, F.lit("="))))
    longest = F.array_max(F.transform(owners, lambda c: F.struct(F.length(c).alias("size"), c.alias("owner"))))["owner"]
    return (F.when(name.rlike(INDICATOR), F.concat(F.regexp_replace(name, INDICATOR, ""), F.lit(" (was missing)")))
            .when(F.array_contains(names(numeric + categorical), name), name)
            .otherwise(F.coalesce(longest, name)))


# -------------------------------------------------------------------- E5
def fold_importance(scores: DataFrame, mapping: DataFrame | None = None, group: list[str] | None = None,
                    top: int | None = K.TOP_FEATURES_REPORTED) -> DataFrame:
    """E5: sum encoded scores into their source column, count the parts,
    rank (ties by name) and keep the top ``top`` (None: all). ``scores`` has
    ``encoded, importance`` (+ ``source`` or a ``mapping`` to join)."""
    group = group or []
    s = scores if mapping is None else scores.join(F.broadcast(mapping), "encoded")
    folded = s.groupBy(*group, F.col("source").alias("feature")).agg(
        F.sum("importance").alias("importance"), F.count(F.lit(1)).alias("encoded_parts"))
    w = Window.partitionBy(*group).orderBy(F.col("importance").desc(), F.col("feature").asc()) if group \
        else Window.orderBy(F.col("importance").desc(), F.col("feature").asc())
    ranked = folded.withColumn("rank", F.row_number().over(w))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return (ranked.select(*group, "feature", "importance", F.col("rank").cast("int").alias("rank"),
                    F.col("encoded_parts").cast("int").alias("encoded_parts")))


# -------------------------------------------------------------------- E6
def explain(outcome, model_name: str | None = None, key: str | None = None,
            use_budget: bool = False, method: str | None = None) -> tuple[str, int, DataFrame, DataFrame | None]:
    """SHAP for forests, permutation for other models or when ``method``
    says so, else ``unavailable``. All held-out rows are explained unless
    ``use_budget`` asks for the row budget. Returns ``(method, rows, features, encoded)`` where
    ``features`` is ``(feature, importance, rank, encoded_parts)``, every feature ranked."""
    spark = outcome.test.sparkSession
    name = model_name or outcome.best_model
    model = outcome.models[name]
    classification = outcome.task_type == "classification"
    key = key or outcome.test.columns[0]
    mapping = spark.createDataFrame(outcome.prep.encoded(), "encoded string, source string")
    if "random_forest" in name and method in (None, "shap"):
        try:
            rows = spark.range(1).select(shap_budget(F.lit(model.totalNumNodes))[0].cast("int")).first()[0] if use_budget else None
            enc = [e for e, _ in outcome.prep.encoded()]
            scores, n, _ = tree_shap(model, outcome.test, enc, classification, 1, rows, key)
            scores = scores.persist()
            feats = fold_importance(scores, mapping, top=None)
            w = Window.orderBy(F.col("importance").desc(), F.col("encoded").asc())
            encoded = scores.withColumn("rank", F.row_number().over(w))
            return "shap", n, feats, encoded
        except Exception:  # noqa: BLE001 - fall back to permutation, on the record
            LOG.exception("SHAP failed; permutation importance instead")
    try:
        imp = permutation_importance(model, outcome.prep, outcome.test, key, classification)
        w = Window.orderBy(F.col("importance").desc(), F.col("feature").asc())
        feats = (imp.withColumn("rank", F.row_number().over(w))
                 .select("feature", "importance", F.col("rank").cast("int").alias("rank"),
                         F.lit(1).alias("encoded_parts")))
        return "permutation", outcome.n_test, feats, None
    except Exception:  # noqa: BLE001 - explanation is optional
        LOG.exception("permutation importance failed")
        empty = spark.createDataFrame([], "feature string, importance double, rank int, encoded_parts int")
        return "unavailable", 0, empty, None
