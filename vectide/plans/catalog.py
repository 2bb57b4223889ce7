"""The registered queries of the vector engine and their SQL.

Searches take as queries every vector whose id is divisible by 100, against all
rows.  Sums over rows are rounded to six places on both sides, as neither engine
fixes their order.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions import codec, sizing
from vectide.functions import vectors as V
from vectide.operators import assign, kmeans, maintain, policy, rabitq, rank, router, search
from vectide.sources import bigann, wire

K = 10


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    """A new folder for benchmark files: among those that driver and executors share, or, where the session names none, on this machine, if it is all there is."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    shared = urlparse(named or "")
    if shared.scheme not in ("", "file"):
        raise ValueError("benchmark files are read as local files; spark.checkpoint.dir has to be a mounted folder")
    if named:
        os.makedirs(shared.path, exist_ok=True)
    return tempfile.mkdtemp(prefix="vectide-", dir=shared.path or None)


def _rows(spark, d) -> DataFrame:
    return _read(spark, d, "embeddings").select("vec_id", "embedding", "label")


def _queries(spark, d) -> DataFrame:
    return _rows(spark, d).where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _labelled(spark, d) -> DataFrame:
    return _rows(spark, d).withColumn("cluster_id", F.col("label").cast("long"))


def _label_centroids(spark, d) -> DataFrame:
    return assign.centroids_of(_labelled(spark, d), "cluster_id")


def _fine(spark, d) -> DataFrame:
    """Forty fixed centroids: of each label's rows by id modulo 4."""
    return assign.centroids_of(_rows(spark, d).withColumn("cluster_id", (F.col("label") * 4 + F.col("vec_id") % 4).cast("long")), "cluster_id")


def pairwise(metric: str) -> Callable:
    def query(spark, d):
        pairs = _rows(spark, d).crossJoin(F.broadcast(_queries(spark, d)))
        return pairs.select("query_id", F.col("vec_id").alias("id"), V.score(metric, "query", "embedding").alias("score"))

    return query


def vector_norms(spark, d):
    return _rows(spark, d).select("vec_id", V.norm_sq("embedding").alias("norm_sq"), V.norm("embedding").alias("norm"), F.size("embedding").cast("long").alias("dims"))


def normalized_vectors(spark, d):
    """Vectors of orders and line items, which are not unit length."""
    rows = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_quantity", "l_discount", "l_tax").alias("v"))
    n = rows.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), V.normalize("v").alias("n"))
    return n.select("l_orderkey", "l_linenumber", *[F.round(F.col("n")[k], 9).alias(f"n{k}") for k in range(3)])


def validate_vectors(spark, d):
    rows = _rows(spark, d)
    odd = rows.withColumn("embedding", F.when(F.col("vec_id") % 7 == 3, F.transform("embedding", lambda x, k: F.when(k == F.col("vec_id") % 64, F.lit(float("nan"))).otherwise(x))).otherwise(F.col("embedding")))
    return odd.select("vec_id", V.non_finite("embedding").alias("first_bad"), V.usable("embedding", 64).alias("usable"))


def knn_exact(metric: str) -> Callable:
    return lambda spark, d: search.exact(_rows(spark, d), _queries(spark, d), K, metric)


def knn_scan(spark, d):
    """The Arrow form of knn_exact_l2; scores rounded, as its sums run in another order."""
    q = _queries(spark, d).toArrow()
    found = search.exact_scan(_rows(spark, d), q["query_id"].to_numpy(), V.matrix(q["query"]), K)
    return found.select("query_id", "rank", "id", (F.round("score", 6) + F.lit(0.0)).alias("score"))


def topk_nan_ties(spark, d):
    hits = _read(spark, d, "lineitem").select("l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_linenumber") % 6 == 0, F.lit(float("nan"))).otherwise(F.floor(F.col("l_quantity") / 10).cast("double")).alias("score"))
    return rank.top_k(hits, 50, ["l_returnflag"]).select("l_returnflag", "rank", "id", "score")


def topk_cutoff(spark, d):
    hits = _read(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("score"))
    return rank.cutoff(hits, 25, ["l_suppkey"]).select("l_suppkey", "id", "score")


def topk_global(spark, d):
    hits = _read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    return rank.select(hits, 100)


def assign_label_centroids(spark, d):
    found = assign.nearest(_rows(spark, d), _label_centroids(spark, d))
    return found.select("vec_id", "cluster_id", F.round("d2", 6).alias("d2"))


def assign_scan(spark, d):
    """The Arrow form of assign_label_centroids."""
    c = _label_centroids(spark, d).toArrow()
    found = assign.assign(_rows(spark, d).select("vec_id", "embedding"), c["cluster_id"].to_numpy(), np.array(c["centroid"].to_pylist()))
    return found.select("vec_id", "cluster_id", F.round("d2", 5).alias("d2"))


def cluster_stats_radius(spark, d):
    found = assign.cluster_stats(_labelled(spark, d), _label_centroids(spark, d))
    return found.select("cluster_id", "count", F.round("radius", 6).alias("radius"))


def cluster_sse(spark, d):
    return assign.sse(_labelled(spark, d), _label_centroids(spark, d)).select(F.round("sse", 6).alias("sse"))


def farthest_member(spark, d):
    return assign.farthest(_labelled(spark, d), _label_centroids(spark, d)).select("cluster_id", "vec_id", F.round("d2", 6).alias("d2"))


def nearest_other_cluster(spark, d):
    return assign.nearest_other(_label_centroids(spark, d)).select("cluster_id", "other_id", F.round("d2", 6).alias("d2"))


def two_level_assign(spark, d):
    return assign.two_level_assign(_rows(spark, d), _label_centroids(spark, d), _fine(spark, d), probe=3).select("vec_id", "cluster_id", F.round("d2", 6).alias("d2"))


def two_stage_assign(spark, d):
    fine = _fine(spark, d).withColumn("group_id", F.floor(F.col("cluster_id") / 4).cast("long"))
    groups = _label_centroids(spark, d).select(F.col("cluster_id").alias("group_id"), "centroid")
    rows = _rows(spark, d).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return router.two_stage_assign(rows, groups, fine, top=4).select("query_id", "cluster_id", F.round("d2", 6).alias("d2"))


def beam_search_fixed_tree(spark, d):
    """A root, a node for each label, and forty leaves."""
    groups = _label_centroids(spark, d).select((F.col("cluster_id") + 1).alias("node_id"), F.lit(0).cast("long").alias("parent_id"), F.lit(None).cast("long").alias("leaf_id"), "centroid")
    leaves = _fine(spark, d).select(F.lit(None).cast("long").alias("node_id"), (F.floor(F.col("cluster_id") / 4) + 1).cast("long").alias("parent_id"), F.col("cluster_id").alias("leaf_id"), "centroid")
    root = spark.range(1).select(F.lit(0).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(None).cast("long").alias("leaf_id"), F.expr("cast(array() as array<double>)").alias("centroid"))
    return router.beam_search(_queries(spark, d), root.unionByName(groups).unionByName(leaves), beam=3, probe=5, depth=2)


def ivf_search_fixed_centroids(spark, d):
    return search.clustered(_labelled(spark, d), _label_centroids(spark, d), _queries(spark, d), K, nprobe=3)


def ivf_recall_by_nprobe(spark, d):
    truth = search.exact(_rows(spark, d), _queries(spark, d), K)
    out = None
    for n in (1, 2, 5, 10):
        got = search.clustered(_labelled(spark, d), _label_centroids(spark, d), _queries(spark, d), K, nprobe=n)
        own = rank.recall_at_k(got, truth, K).select(F.lit(n).cast("long").alias("nprobe"), F.round("recall", 6).alias("recall"))
        out = own if out is None else out.unionByName(own)
    return out


def sizing_curve(spark, d):
    n = F.col("o_orderkey")
    k = sizing.hood_k_col(n)
    return _read(spark, d, "orders").select(n.alias("rows"), k.alias("k"), sizing.default_nprobe_col(k).alias("nprobe"), sizing.hood_size_col(n).alias("size"), sizing.split_above_col(n).alias("split_above"), sizing.merge_below_col(n).alias("merge_below"))


def _supplier_stats(spark, d) -> tuple[DataFrame, DataFrame]:
    """Customers as clusters of one number: by nation, but nation 5 and most of nations 3, 7 and 9 are of cluster 4, which gets too large and leaves some tiny."""
    away = (F.col("c_nationkey") == 5) | (F.col("c_nationkey").isin(3, 7, 9) & (F.col("c_custkey") % 9 != 0))
    rows = _read(spark, d, "customer").select(F.when(away, 4).otherwise(F.col("c_nationkey")).cast("long").alias("cluster_id"), F.array("c_acctbal").alias("embedding"))
    c = assign.centroids_of(rows, "cluster_id")
    return assign.cluster_stats(rows, c), c


def split_target(spark, d):
    return policy.split_target(_supplier_stats(spark, d)[0])


def merge_candidates(spark, d):
    return policy.merge_candidates(*_supplier_stats(spark, d), most=160)


def merge_plan(spark, d):
    pairs = policy.merge_targets(*_supplier_stats(spark, d), pairs=10)
    return spark.createDataFrame(pairs, "tiny long, host long")


def merge_owed(spark, d):
    return spark.createDataFrame([(policy.merge_owed(_supplier_stats(spark, d)[0]),)], "owed boolean")


def dense_affine(scalar: str) -> Callable:
    def query(spark, d):
        coded = codec.dense_blocks(_rows(spark, d), "label", scalar)
        sizes = F.aggregate("codes", F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
        back = codec.dense_decode()
        return coded.select("vec_id", F.round("scale", 9).alias("scale"), F.round("offset", 9).alias("offset"), sizes.alias("code_sum"), F.round(V.l2_sq("embedding", back), 6).alias("error"))

    return query


def dense_scores(spark, d):
    coded = codec.dense_blocks(_rows(spark, d), "label", "i8").withColumn("r", codec.dense_decode())
    pairs = coded.crossJoin(F.broadcast(_queries(spark, d)))
    return pairs.select("query_id", F.col("vec_id").alias("id"), F.round(codec.dense_score("l2", "query", "r"), 6).alias("score"))


def i8_codec_roundtrip(spark, d):
    wide = F.transform("embedding", lambda x: x.cast("double") * 400)
    return _rows(spark, d).select("vec_id", F.posexplode(codec.round_i8(wide)).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x"))


def f16_codec_roundtrip(spark, d):
    back = codec.from_f16(codec.with_f16(_rows(spark, d).select("vec_id", "embedding")))
    return back.select("vec_id", F.round(V.l2_sq("embedding", "decoded"), 12).alias("error"))


def _slots(df: DataFrame) -> DataFrame:
    return df.select(F.col("cluster_id").alias("slot_id"), F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


def _sets(spark, d) -> tuple[DataFrame, DataFrame]:
    """Ten label centroids; and eight, about which labels 8 and 9 and the even labels' odd ids have moved to label 1."""
    rows = _labelled(spark, d)
    later = rows.withColumn("cluster_id", F.when((F.col("label") >= 8) | ((F.col("label") % 2 == 0) & (F.col("vec_id") % 2 == 1)), 1).otherwise(F.col("label")).cast("long"))
    return _slots(assign.centroids_of(rows, "cluster_id")), _slots(assign.centroids_of(later, "cluster_id"))


def centroid_delta(spark, d):
    found = maintain.delta(*_sets(spark, d), limit=64)
    return found.select("seq", "slot_id", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 4).alias("vec_sum"))


def apply_centroid_delta(spark, d):
    prev, now = _sets(spark, d)
    found = maintain.apply_deltas(prev, maintain.delta(prev, now, limit=64))
    return found.select("slot_id", F.posexplode("centroid").alias("pos", "x")).select("slot_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


def balanced_split_step(spark, d):
    """A step of every label's balanced split about the means of its even and odd ids."""
    rows = _labelled(spark, d)
    half = lambda k: assign.centroids_of(rows.where(F.col("vec_id") % 2 == k), "cluster_id").withColumnRenamed("centroid", f"c{k}")
    return kmeans.split_step(rows, half(0).join(half(1), "cluster_id"))


def knn_self_join_topk(spark, d):
    """The three nearest other centroids of each of forty."""
    c = _fine(spark, d)
    q = c.select(F.col("cluster_id").alias("query_id"), F.col("centroid").alias("query"))
    hits = c.select(F.col("cluster_id").alias("vec_id"), F.col("centroid").alias("embedding"))
    found = search.exact(hits, q, 4).where("query_id <> id")
    return rank.top_k(found.drop("rank"), 3, ["query_id"]).select("query_id", "rank", "id", F.round("score", 9).alias("score"))


def _tree(spark, d) -> router.Tree:
    c = _fine(spark, d).orderBy("cluster_id").toArrow()
    return router.Tree.build(np.array(c["centroid"].to_pylist()), 4)


def tree_build(spark, d):
    """Forty clusters in a tree, found again with a beam as wide as the tree."""
    return router.route(_queries(spark, d), _tree(spark, d).quantise(), probe=5, beam=1000)


def tree_upsert(spark, d):
    """The same after cluster 5 has moved to the vector 7 and the vector 8 has become cluster 40."""
    t = _tree(spark, d).upsert(5, np.array(V.decode_row(_rows(spark, d), 7))).upsert(40, np.array(V.decode_row(_rows(spark, d), 8)))
    return router.route(_queries(spark, d), t, probe=5, beam=1000)


def tree_truncate(spark, d):
    """The same with the first thirty clusters."""
    return router.route(_queries(spark, d), _tree(spark, d).truncate(30), probe=5, beam=1000)


def tree_bytes(spark, d):
    """The same from the tree's bytes."""
    return router.route(_queries(spark, d), wire.decode_tree(wire.encode_tree(_tree(spark, d))), probe=5, beam=1000)


def block_tree_route(spark, d):
    """The same past a tree of encoded blocks."""
    c = _fine(spark, d).orderBy("cluster_id").toArrow()
    return router.route_blocks(_queries(spark, d), router.BlockTree(np.array(c["centroid"].to_pylist()), 4, router.FloatBlock), probe=5, beam=1000)


def tree_route_work(spark, d):
    """Distances that routing all vectors takes: with 8-bit copies most are of integers, and the answer is the same."""
    q = _rows(spark, d).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    plain, copies = (router.route_work(q, t, probe=3, beam=4) for t in (_tree(spark, d), _tree(spark, d).quantise()))
    a, b = (x.agg(F.sum("floats").alias("floats"), F.sum("quantised").alias("quantised"), F.sum(F.xxhash64("query_id", "found").cast("decimal(38,0)")).alias("answer")).first() for x in (plain, copies))
    return spark.createDataFrame([(b["floats"] < a["floats"], b["quantised"] > 0, a["answer"] == b["answer"])], "fewer_floats boolean, integers boolean, same_answer boolean")


def rabitq_append(spark, d):
    """Rows of odd ids coded in the frames of the even ones, behind theirs."""
    rows = _labelled(spark, d)
    even, odd = rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 = 1")
    frames = rabitq.frames_of(even, 42)
    coded = rabitq.append_codes(rabitq.codes_of(even, frames), odd, frames)
    return coded.select("cluster_id", "vec_id", F.round("norm", 6).alias("norm"))


def rabitq_select(spark, d):
    """A code for every order, at its position, most of them again and again."""
    rows = _labelled(spark, d)
    frames = rabitq.frames_of(rows, 42)
    wanted = _read(spark, d, "orders").select(F.col("o_orderkey").alias("position"), (F.col("o_orderkey") * 7 % 500).alias("vec_id"))
    return maintain.select_rows(rabitq.codes_of(rows, frames), wanted).select("position", "cluster_id", "vec_id", F.round("norm", 6).alias("norm"))


def rabitq_signbits(spark, d):
    """The 64 signs of every code."""
    rows = _labelled(spark, d)
    coded = rabitq.codes_of(rows, rabitq.frames_of(rows, 42))
    signs = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.getbit(F.col("bits")[0], j).cast("string")), "")
    return coded.select("cluster_id", "vec_id", signs.alias("signs"), F.round("align", 6).alias("align"))


def rabitq_estimate(spark, d):
    """Estimates and bounds of all rows for every query, at the default width of the bound."""
    rows, q = _labelled(spark, d), _queries(spark, d)
    frames = rabitq.frames_of(rows, 42)
    chosen = search.probes(q, _label_centroids(spark, d), 10).join(q, "query_id")
    found = search.estimates(rabitq.codes_of(rows, frames), frames, chosen)
    return found.select("query_id", "id", (F.round("estimate", 6) + F.lit(0.0)).alias("estimate"), (F.round("bound", 6) + F.lit(0.0)).alias("bound"))


def rabitq_bit_product(spark, d):
    """Sums of the queries' levels over the signs of all codes, by counting bits in the JVM."""
    rows, q = _labelled(spark, d), _queries(spark, d)
    frames = rabitq.frames_of(rows, 42)
    planes = rabitq.planes_of(search.probes(q, _label_centroids(spark, d), 10).join(q, "query_id"), frames)
    both = rabitq.codes_of(rows, frames).join(planes, "cluster_id")
    return both.select("query_id", F.col("vec_id").alias("id"), rabitq.bit_product().alias("product"))


def rabitq_pruned(spark, d):
    """Rows of the probed clusters whose bounds the tenth exact score of each query lets pass, of how many."""
    rows, q, c = _labelled(spark, d), _queries(spark, d), _label_centroids(spark, d)
    frames = rabitq.frames_of(rows, 42)
    codes = rabitq.codes_of(rows, frames)
    cut = rank.cutoff(search.exact(rows, q, K), K, ["query_id"]).select("query_id", F.col("score").alias("cutoff"))
    chosen = search.probes(q, c, 10).join(q, "query_id")
    read = search.reaching(codes, frames, chosen.join(cut, "query_id")).groupBy("query_id").agg(F.count("*").alias("read"))
    every = search.estimates(codes, frames, chosen).groupBy("query_id").agg(F.count("*").alias("rows"))
    return every.join(read, "query_id").select("query_id", "rows", (F.col("read") < F.col("rows")).alias("pruned"))


def ground_truth(spark, d):
    """The ten nearest rows of each query through a ground-truth file."""
    found = search.exact(_rows(spark, d), _queries(spark, d), K).orderBy("query_id", "rank").toArrow()
    ids = found["id"].to_numpy().reshape(-1, K)
    path = f"{_folder(spark)}/truth.ibin"
    bigann.register(spark)
    bigann.write_truth(path, ids, -found["score"].to_numpy().reshape(-1, K))
    return spark.read.format("bigann").load(path).select((F.col("query_id") * 100).alias("query_id"), "rank", F.col("id").cast("long").alias("id"))


def dense_f16_blocks(spark, d):
    coded = codec.dense_blocks(_rows(spark, d), "label", "f16")
    return coded.select("vec_id", F.round(V.l2_sq("embedding", codec.dense_decode()), 12).alias("error"))


def code_bytes(spark, d):
    """Codes with three extended bits, as bytes of a column for each cluster and back."""
    rows = _labelled(spark, d)
    frames = rabitq.frames_of(rows, 42, ex_bits=3)
    back = rabitq.codes_from_bytes(rabitq.bytes_of(rabitq.codes_of(rows, frames), frames), frames)
    return back.select("cluster_id", "vec_id", F.round("norm", 6).alias("norm"))


def rabitq_codes(spark, d):
    rows = _labelled(spark, d)
    frames = rabitq.frames_of(rows, rabitq.seed_of("embeddings", "embedding"))
    coded = rabitq.codes_of(rows, frames)
    ones = F.aggregate("bits", F.lit(0).cast("long"), lambda a, x: a + F.bit_count(x).cast("long"))
    return coded.select("cluster_id", "vec_id", F.round("norm", 6).alias("norm"), ones.alias("ones"), F.round("align", 6).alias("align"))


def rabitq_norms(spark, d):
    return rabitq_codes(spark, d).select("cluster_id", "vec_id", "norm")


def _two_pass(ex_bits: int = 0, nprobe: int = 10, **options) -> Callable:
    def query(spark, d):
        rows, c, q = _labelled(spark, d), _label_centroids(spark, d), _queries(spark, d)
        frames = rabitq.frames_of(rows, 42, ex_bits=ex_bits)
        return search.two_pass(rows, rabitq.codes_of(rows, frames), frames, c, q, K, nprobe=nprobe, **options)

    return query


def kmeans_fit(spark, d):
    rows = _rows(spark, d)
    fitted = kmeans.KMeans(sizing.hood_k(rows.count())).fit(rows)
    return fitted.assign(rows.select("vec_id", "embedding")).select("vec_id", "cluster_id")


def _line_vectors(spark, d) -> DataFrame:
    scaled = F.array(*[F.col(c).cast("float") for c in ("q", "p", "s", "t")])
    own = _read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("vec_id"), (F.col("l_quantity") / 50).alias("q"), (F.col("l_extendedprice") / 100000).alias("p"), (F.col("l_discount") * 10).alias("s"), (F.col("l_tax") * 12).alias("t"))
    return own.select("vec_id", scaled.alias("embedding"))


def kmeans_two_level(spark, d):
    rows = _line_vectors(spark, d)
    fitted = kmeans.KMeans(600, iters=4).fit(rows)
    return fitted.assign(rows).groupBy("cluster_id").agg(F.count("*").alias("count"), F.avg("d2").alias("mse"))


def tree_route(spark, d):
    rows = _line_vectors(spark, d)
    c = kmeans.KMeans(sizing.hood_k(rows.count()), iters=4).fit(rows).centroids
    tree = router.Tree.build(c, 16).quantise()
    return router.route(rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), tree, probe=1, beam=4)


def balanced_splits(spark, d):
    return kmeans.split_clusters(_labelled(spark, d))


def bigann_scan(spark, d):
    bigann.register(spark)
    t = _rows(spark, d).orderBy("vec_id").toArrow()
    path = f"{_folder(spark)}/e.fbin"
    bigann.write(path, V.matrix(t["embedding"]))
    return spark.read.format("bigann").load(path).select("vec_id", V.norm_sq("embedding").alias("norm_sq"))


def queries() -> dict:
    """Every query by name."""
    named = (
        vector_norms, normalized_vectors, validate_vectors, knn_scan, topk_nan_ties, topk_cutoff, topk_global, assign_label_centroids, assign_scan, cluster_stats_radius, cluster_sse,
        farthest_member, nearest_other_cluster, two_level_assign, two_stage_assign, beam_search_fixed_tree, ivf_search_fixed_centroids, ivf_recall_by_nprobe, sizing_curve, split_target,
        merge_candidates, merge_plan, merge_owed, dense_scores, i8_codec_roundtrip, f16_codec_roundtrip, centroid_delta, apply_centroid_delta, balanced_split_step, rabitq_codes, rabitq_norms,
        kmeans_fit, kmeans_two_level, tree_route, balanced_splits, bigann_scan, knn_self_join_topk, tree_build, tree_upsert, tree_truncate, tree_bytes, block_tree_route, tree_route_work,
        rabitq_append, rabitq_select, rabitq_signbits, rabitq_estimate, rabitq_bit_product, rabitq_pruned, ground_truth, dense_f16_blocks, code_bytes,
    )
    out = {f.__name__: f for f in named}
    out |= {f"pairwise_{m}": pairwise(m) for m in V.METRICS} | {f"knn_exact_{m}": knn_exact(m) for m in V.METRICS}
    out |= {"dense_i8_affine": dense_affine("i8"), "dense_u8_affine": dense_affine("u8")}
    return out | {
        "rabitq_two_pass_exact": _two_pass(exact_bounds=True),
        "rabitq_two_pass": _two_pass(sigmas=8.0),
        "rabitq_two_pass_default": _two_pass(nprobe=3),
        "rabitq_two_pass_extended": _two_pass(ex_bits=3, shared=True, sigmas=8.0),
    }


# the same in DuckDB


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


def _l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"


_SCORES = {
    "l2": f"-{_l2('q.embedding', 'e.embedding')}",
    "ip": _dot("q.embedding", "e.embedding"),
    "cosine": f"CASE WHEN {_dot('q.embedding', 'q.embedding')} = 0 OR {_dot('e.embedding', 'e.embedding')} = 0 THEN 0 ELSE {_dot('q.embedding', 'e.embedding')} / sqrt({_dot('q.embedding', 'q.embedding')} * {_dot('e.embedding', 'e.embedding')}) END",
}
_ALL = lambda m: f"SELECT q.vec_id AS query_id, e.vec_id AS id, {_SCORES[m]} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0"


def _top(source: str, k: int = K, by: str = "query_id", score: str = "score") -> str:
    return f"SELECT query_id, rank, id, {score} AS score FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY isnan(score), score DESC, id)::BIGINT AS rank FROM ({source})) WHERE rank <= {k}"


def _means(source: str, by: str = "cluster_id") -> str:
    return f"SELECT {by}, list(m ORDER BY pos) AS centroid FROM (SELECT {by}, pos, avg(embedding[pos]::DOUBLE) AS m FROM (SELECT *, unnest(range(1, 65)) AS pos FROM ({source})) GROUP BY ALL) GROUP BY ALL"


_LABELLED = "SELECT *, label::BIGINT AS cluster_id FROM embeddings"
_CENTROIDS = _means(_LABELLED)
_FINE = _means("SELECT *, (label * 4 + vec_id % 4)::BIGINT AS cluster_id FROM embeddings")
_HITS = f"probes AS (SELECT * FROM (SELECT q.vec_id AS query_id, c.cluster_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_l2('q.embedding', 'c.centroid')}, c.cluster_id) AS place FROM embeddings q, c WHERE q.vec_id % 100 = 0))"
_BY_NPROBE = f"SELECT p.query_id, e.vec_id AS id, -{_l2('q.embedding', 'e.embedding')} AS score FROM probes p JOIN embeddings q ON q.vec_id = p.query_id JOIN embeddings e ON e.label = p.cluster_id WHERE p.place <= "
_SIZES = """
    k AS (SELECT *, CASE WHEN n < 1 THEN 1 ELSE least(greatest(ceil(n / 196.0)::BIGINT, least(16, floor(sqrt(n) + 0.5)::BIGINT), 1), n) END AS k FROM n),
    s AS (SELECT *, greatest(1, n // k)::BIGINT AS size FROM k),
    band AS (SELECT *, (size * 7 // 5)::BIGINT AS above, greatest(3, size // 4)::BIGINT AS below FROM s)"""
_STATS = f"""
    r AS (SELECT CASE WHEN c_nationkey = 5 OR (c_nationkey IN (3, 7, 9) AND c_custkey % 9 <> 0) THEN 4 ELSE c_nationkey END::BIGINT AS cluster_id, c_acctbal AS x FROM customer),
    c AS (SELECT cluster_id, avg(x) AS m FROM r GROUP BY ALL),
    stats AS (SELECT cluster_id, count(*) AS count, avg(abs(x - m)) AS radius FROM r JOIN c USING (cluster_id) GROUP BY ALL),
    n AS (SELECT sum(count)::BIGINT AS n FROM stats), {_SIZES}"""
_TINY = f"""{_STATS},
    t AS (SELECT s.*, (SELECT min(o.count) FROM stats o WHERE o.cluster_id <> s.cluster_id) AS other FROM stats s),
    tiny AS (SELECT t.* FROM t, band WHERE count <= below AND count + other <= above)"""
_NEAR = "near AS (SELECT * FROM (SELECT a.cluster_id, b.cluster_id AS other_id, row_number() OVER (PARTITION BY a.cluster_id ORDER BY (a.m - b.m) * (a.m - b.m), b.cluster_id) AS r FROM c a, c b WHERE a.cluster_id <> b.cluster_id) WHERE r = 1)"
_CANDIDATES = "SELECT t.cluster_id, n.other_id, t.count, s.count AS other_count, row_number() OVER (ORDER BY t.count, t.cluster_id)::BIGINT AS place FROM tiny t JOIN near n USING (cluster_id) JOIN stats s ON s.cluster_id = n.other_id WHERE t.count >= 1"
_LATER = "SELECT *, CASE WHEN label >= 8 OR (label % 2 = 0 AND vec_id % 2 = 1) THEN 1 ELSE label END::BIGINT AS cluster_id FROM embeddings"
_HALF = "list_transform(embedding, lambda x: CASE WHEN x = 0 THEN 0.0 ELSE round_even(x::DOUBLE / pow(2.0, greatest(floor(log2(abs(x::DOUBLE))), -14.0) - 10), 0) * pow(2.0, greatest(floor(log2(abs(x::DOUBLE))), -14.0) - 10) END)"


def _routed(centroids: str) -> str:
    """The five nearest centroids (cluster_id, centroid) of each query."""
    d = _l2("e.embedding", "f.centroid")
    return f"SELECT query_id, place, cluster_id FROM (SELECT e.vec_id AS query_id, f.cluster_id, row_number() OVER (PARTITION BY e.vec_id ORDER BY {d}, f.cluster_id)::BIGINT AS place FROM embeddings e, ({centroids}) f WHERE e.vec_id % 100 = 0) WHERE place <= 5"


def _turned() -> str:
    """The rotation of seed 42 as rows (j, r)."""
    turn = rabitq.rotation(42, 64).apply(np.eye(64)).T
    return "rot AS (SELECT unnest(range(0, 64)) AS j, unnest([" + ", ".join("[" + ", ".join(map(repr, row)) + "]" for row in turn.tolist()) + "]) AS r)"


def _codes_sql() -> str:
    """Signs and aligns of the codes about the label centroids."""
    minus = "list_transform(list_zip({a}.embedding, c.centroid), lambda p: p[1]::DOUBLE - p[2])"
    return f"""c AS ({_CENTROIDS}), {_turned()},
        o AS (SELECT c.cluster_id, e.vec_id, {minus.format(a='e')} AS x FROM embeddings e JOIN c ON c.cluster_id = e.label),
        u AS (SELECT cluster_id, vec_id, j, {_dot('x', 'r')} / sqrt({_dot('x', 'x')}) AS u, sqrt({_dot('x', 'x')}) AS norm FROM o, rot),
        al AS (SELECT cluster_id, vec_id, any_value(norm) AS norm, sum(abs(u)) / 8 AS align, string_agg(CASE WHEN u >= 0 THEN '1' ELSE '0' END, '' ORDER BY j) AS signs FROM u GROUP BY ALL),
        qr AS (SELECT q.vec_id AS query_id, c.cluster_id, j, {_dot(minus.format(a='q'), 'r')} AS r FROM embeddings q, c, rot WHERE q.vec_id % 100 = 0),
        qn AS (SELECT query_id, cluster_id, sqrt(sum(r * r)) AS qn FROM qr GROUP BY ALL),
        grid AS (SELECT query_id, cluster_id, any_value(qn) AS qn, min(r / qn) AS lo, (max(r / qn) - min(r / qn)) / 15 AS step FROM qr JOIN qn USING (query_id, cluster_id) GROUP BY ALL),
        g AS (SELECT query_id, cluster_id, j, qn, r / qn AS t, lo + step * floor((r / qn - lo) / step + 0.5) AS g FROM qr JOIN grid USING (query_id, cluster_id)),
        s AS (SELECT query_id, cluster_id, any_value(qn) AS qn, sum((g - t) * (g - t)) / 64 AS spread, sum(g) AS sg FROM g GROUP BY ALL),
        raw AS (SELECT query_id, cluster_id, vec_id, sum(CASE WHEN u >= 0 THEN g ELSE 0 END) AS plus FROM g JOIN u USING (cluster_id, j) GROUP BY ALL),
        f AS (SELECT query_id, vec_id AS id, norm, align, qn, spread, (2 * plus - sg) / 8 / align AS ip, greatest(1 - align * align, 0) / 63 AS o2 FROM raw JOIN s USING (query_id, cluster_id) JOIN al USING (cluster_id, vec_id)),
        t AS (SELECT *, abs(ip) - 2.5 * sqrt(o2 + spread) / align AS near, norm * norm + qn * qn - 2 * norm * qn * ip AS d2, (norm - qn) * (norm - qn) AS least FROM f),
        w AS (SELECT *, sqrt(o2 * CASE WHEN near > 0 THEN greatest(1 - near * near, 0) ELSE 1 END + spread) / align AS sigma FROM t)"""


_AFFINE = """
    span AS (SELECT label, min(list_min(embedding))::DOUBLE AS lo, max(list_max(embedding))::DOUBLE AS hi FROM embeddings GROUP BY ALL),
    scaled AS (SELECT label, (hi - lo) / 255.0 AS scale, CASE WHEN hi = lo THEN lo ELSE lo - (hi - lo) / 255.0 * {low} END AS o FROM span),
    coded AS (SELECT e.vec_id, e.embedding, scale, o, list_transform(e.embedding, lambda x: CASE WHEN scale = 0 THEN 0 ELSE greatest({low}, least({high}, round((x::DOUBLE - o) / scale))) END::INT) AS codes FROM embeddings e JOIN scaled USING (label)),
    back AS (SELECT *, list_transform(codes, lambda c: o + scale * c::DOUBLE) AS r FROM coded)"""


def _nearest(rows: str, centroids: str, ident: str) -> str:
    return f"SELECT {ident}, cluster_id, round(d2, 6) AS d2 FROM (SELECT e.vec_id AS {ident}, c.cluster_id, {_l2('e.embedding', 'c.centroid')} AS d2, row_number() OVER (PARTITION BY e.vec_id ORDER BY {_l2('e.embedding', 'c.centroid')}, c.cluster_id) AS r FROM {rows} e, {centroids} c) WHERE r = 1"


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    d2 = _l2("e.embedding", "c.centroid")
    own = f"SELECT e.label::BIGINT AS cluster_id, e.vec_id, {d2} AS d2 FROM embeddings e JOIN c ON c.cluster_id = e.label"
    out = {f"pairwise_{m}": _ALL(m) for m in V.METRICS} | {f"knn_exact_{m}": _top(_ALL(m)) for m in V.METRICS}
    out |= {k: _top(_ALL("l2")) for k in ("rabitq_two_pass_exact", "rabitq_two_pass", "rabitq_two_pass_extended")}
    for name, low, high in (("i8", "-128", "127"), ("u8", "0", "255")):
        out[f"dense_{name}_affine"] = f"WITH {_AFFINE.format(low=low, high=high)} SELECT vec_id, round(scale, 9) AS scale, round(o, 9) AS \"offset\", list_sum(codes)::BIGINT AS code_sum, round({_l2('embedding', 'r')}, 6) AS error FROM back"
    fine = f"c AS ({_CENTROIDS}), f AS ({_FINE})"
    return out | {
        "vector_norms": f"SELECT vec_id, {_dot('embedding', 'embedding')} AS norm_sq, sqrt({_dot('embedding', 'embedding')}) AS norm, len(embedding)::BIGINT AS dims FROM embeddings",
        "normalized_vectors": "WITH n AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity AS a, l_discount AS b, l_tax AS c, sqrt(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax) AS n FROM lineitem) SELECT l_orderkey, l_linenumber, round(CASE WHEN n = 0 THEN a ELSE a / n END, 9) AS n0, round(CASE WHEN n = 0 THEN b ELSE b / n END, 9) AS n1, round(CASE WHEN n = 0 THEN c ELSE c / n END, 9) AS n2 FROM n",
        "validate_vectors": "SELECT vec_id, CASE WHEN vec_id % 7 = 3 THEN vec_id % 64 ELSE -1 END::BIGINT AS first_bad, vec_id % 7 <> 3 AS usable FROM embeddings",
        "knn_scan": _top(_ALL("l2"), score="round(score, 6) + 0.0"),
        "topk_nan_ties": "SELECT l_returnflag, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY isnan(score), score DESC, id)::BIGINT AS rank FROM (SELECT l_returnflag, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber % 6 = 0 THEN 'nan'::DOUBLE ELSE floor(l_quantity / 10) END AS score FROM lineitem)) WHERE rank <= 50",
        "topk_cutoff": "SELECT l_suppkey, id, score FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, id) AS r FROM (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS id, l_extendedprice AS score FROM lineitem)) WHERE r = 25",
        "topk_global": "SELECT o_orderkey AS id, o_totalprice AS score FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
        "assign_label_centroids": f"WITH c AS ({_CENTROIDS}) {_nearest('embeddings', 'c', 'vec_id')}",
        "cluster_stats_radius": f"WITH c AS ({_CENTROIDS}), d AS ({own}) SELECT cluster_id, count(*) AS count, round(avg(sqrt(d2)), 6) AS radius FROM d GROUP BY ALL",
        "cluster_sse": f"WITH c AS ({_CENTROIDS}), d AS ({own}) SELECT round(sum(d2), 6) AS sse FROM d",
        "farthest_member": f"WITH c AS ({_CENTROIDS}), d AS ({own}) SELECT cluster_id, vec_id, round(d2, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY d2 DESC, vec_id) AS r FROM d) WHERE r = 1",
        "nearest_other_cluster": f"WITH c AS ({_CENTROIDS}) SELECT cluster_id, other_id, round(d2, 6) AS d2 FROM (SELECT a.cluster_id, b.cluster_id AS other_id, {_l2('a.centroid', 'b.centroid')} AS d2, row_number() OVER (PARTITION BY a.cluster_id ORDER BY {_l2('a.centroid', 'b.centroid')}, b.cluster_id) AS r FROM c a, c b WHERE a.cluster_id <> b.cluster_id) WHERE r = 1",
        "two_level_assign": f"WITH {fine}, filed AS (SELECT f, g FROM (SELECT f.cluster_id AS f, c.cluster_id AS g, row_number() OVER (PARTITION BY f.cluster_id ORDER BY {_l2('f.centroid', 'c.centroid')}, c.cluster_id) AS r FROM f, c) WHERE r = 1), p AS (SELECT vec_id, g FROM (SELECT e.vec_id, c.cluster_id AS g, row_number() OVER (PARTITION BY e.vec_id ORDER BY {d2}, c.cluster_id) AS r FROM embeddings e, c) WHERE r <= 3) SELECT vec_id, cluster_id, round(d2, 6) AS d2 FROM (SELECT p.vec_id, f.cluster_id, {_l2('e.embedding', 'f.centroid')} AS d2, row_number() OVER (PARTITION BY p.vec_id ORDER BY {_l2('e.embedding', 'f.centroid')}, f.cluster_id) AS r FROM p JOIN filed USING (g) JOIN f ON f.cluster_id = filed.f JOIN embeddings e ON e.vec_id = p.vec_id) WHERE r = 1",
        "two_stage_assign": f"WITH {fine}, p AS (SELECT vec_id, g FROM (SELECT e.vec_id, c.cluster_id AS g, row_number() OVER (PARTITION BY e.vec_id ORDER BY {d2}, c.cluster_id) AS r FROM embeddings e, c) WHERE r <= 4) SELECT query_id, cluster_id, round(d2, 6) AS d2 FROM (SELECT p.vec_id AS query_id, f.cluster_id, {_l2('e.embedding', 'f.centroid')} AS d2, row_number() OVER (PARTITION BY p.vec_id ORDER BY {_l2('e.embedding', 'f.centroid')}, f.cluster_id) AS r FROM p JOIN f ON f.cluster_id // 4 = p.g JOIN embeddings e ON e.vec_id = p.vec_id) WHERE r = 1",
        "beam_search_fixed_tree": f"WITH {fine}, p AS (SELECT vec_id, g FROM (SELECT e.vec_id, c.cluster_id AS g, row_number() OVER (PARTITION BY e.vec_id ORDER BY {d2}, c.cluster_id) AS r FROM embeddings e, c WHERE e.vec_id % 100 = 0) WHERE r <= 3) SELECT query_id, place, cluster_id FROM (SELECT p.vec_id AS query_id, f.cluster_id, row_number() OVER (PARTITION BY p.vec_id ORDER BY {_l2('e.embedding', 'f.centroid')}, f.cluster_id)::BIGINT AS place FROM p JOIN f ON f.cluster_id // 4 = p.g JOIN embeddings e ON e.vec_id = p.vec_id) WHERE place <= 5",
        "ivf_search_fixed_centroids": f"WITH c AS ({_CENTROIDS}), {_HITS} {_top(_BY_NPROBE + '3')}",
        "ivf_recall_by_nprobe": f"WITH c AS ({_CENTROIDS}), {_HITS}, truth AS ({_top(_ALL('l2'))}), {', '.join(f'g{n} AS ({_top(_BY_NPROBE + str(n))})' for n in (1, 2, 5, 10))} "
        + " UNION ALL ".join(f"SELECT {n}::BIGINT AS nprobe, round(avg(hits / 10.0), 6) AS recall FROM (SELECT g.query_id, count(t.id) AS hits FROM g{n} g LEFT JOIN truth t ON t.query_id = g.query_id AND t.id = g.id GROUP BY ALL)" for n in (1, 2, 5, 10)),
        "sizing_curve": f"WITH n AS (SELECT o_orderkey AS n FROM orders), {_SIZES} SELECT n AS rows, k, greatest(1, least(greatest(511, k // 32), greatest(16, k // 4)))::BIGINT AS nprobe, size, above AS split_above, below AS merge_below FROM band",
        "split_target": f"WITH {_STATS}, m AS (SELECT avg(radius) FILTER (count > 0) AS mean FROM stats) SELECT cluster_id FROM (SELECT cluster_id, CASE WHEN count >= 8 AND radius > 0 AND count > above THEN 0 WHEN count >= 8 AND radius > 2 * mean THEN 1 END AS why, count FROM stats, band, m) WHERE why IS NOT NULL ORDER BY why, CASE WHEN why = 0 THEN -count ELSE 0 END, cluster_id LIMIT 1",
        "merge_candidates": f"WITH {_TINY}, {_NEAR} {_CANDIDATES}",
        "merge_plan": f"""WITH RECURSIVE {_TINY}, {_NEAR}, cand AS ({_CANDIDATES}),
            step AS (SELECT 0::BIGINT AS place, []::BIGINT[] AS taken, NULL::BIGINT AS tiny, NULL::BIGINT AS host, 0 AS n
                UNION ALL SELECT c.place, CASE WHEN ok THEN list_concat(taken, [c.cluster_id, c.other_id]) ELSE taken END, CASE WHEN ok THEN c.cluster_id END, CASE WHEN ok THEN c.other_id END, n + ok::INT
                FROM (SELECT s.taken, s.n, c.*, s.n < 10 AND NOT list_contains(s.taken, c.cluster_id) AND NOT list_contains(s.taken, c.other_id) AND c.count + c.other_count <= (SELECT above FROM band) AS ok FROM step s JOIN cand c ON c.place = s.place + 1) c)
            SELECT tiny, host FROM step WHERE tiny IS NOT NULL""",
        "assign_scan": f"WITH c AS ({_CENTROIDS}) {_nearest('embeddings', 'c', 'vec_id').replace('round(d2, 6)', 'round(d2, 5)')}",
        "f16_codec_roundtrip": f"SELECT vec_id, round({_l2('embedding', 'h')}, 12) AS error FROM (SELECT *, {_HALF} AS h FROM embeddings)",
        "dense_f16_blocks": f"SELECT vec_id, round({_l2('embedding', 'h')}, 12) AS error FROM (SELECT *, {_HALF} AS h FROM embeddings)",
        "knn_self_join_topk": f"WITH f AS ({_FINE}) SELECT query_id, rank, id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::BIGINT AS rank FROM (SELECT a.cluster_id AS query_id, b.cluster_id AS id, -{_l2('a.centroid', 'b.centroid')} AS score FROM f a, f b WHERE a.cluster_id <> b.cluster_id)) WHERE rank <= 3",
        "tree_build": _routed(_FINE),
        "tree_bytes": _routed(_FINE),
        "block_tree_route": _routed(_FINE),
        "tree_upsert": _routed(f"SELECT * FROM ({_FINE}) WHERE cluster_id <> 5 UNION ALL SELECT CASE vec_id WHEN 7 THEN 5 ELSE 40 END, list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings WHERE vec_id IN (7, 8)"),
        "tree_truncate": _routed(f"SELECT * FROM ({_FINE}) WHERE cluster_id < 30"),
        "tree_route_work": "SELECT true AS fewer_floats, true AS integers, true AS same_answer",
        "rabitq_append": f"WITH c AS ({_means('SELECT *, label::BIGINT AS cluster_id FROM embeddings WHERE vec_id % 2 = 0')}), d AS ({own}) SELECT cluster_id, vec_id, round(sqrt(d2), 6) AS norm FROM d",
        "rabitq_select": f"WITH c AS ({_CENTROIDS}), d AS ({own}) SELECT o.o_orderkey AS position, cluster_id, vec_id, round(sqrt(d2), 6) AS norm FROM d JOIN orders o ON o.o_orderkey * 7 % 500 = d.vec_id",
        "rabitq_signbits": f"WITH {_codes_sql()} SELECT cluster_id, vec_id, signs, round(align, 6) AS align FROM al",
        "rabitq_estimate": f"WITH {_codes_sql()} SELECT query_id, id, round(-greatest(d2, least), 6) + 0.0 AS estimate, round(-greatest(d2 - 5 * norm * qn * sigma, least), 6) + 0.0 AS bound FROM w",
        "rabitq_bit_product": f"WITH {_codes_sql()} SELECT query_id, vec_id AS id, sum(CASE WHEN u >= 0 THEN round((g - lo) / step) ELSE 0 END)::BIGINT AS product FROM g JOIN grid USING (query_id, cluster_id) JOIN u USING (cluster_id, j) GROUP BY ALL",
        "rabitq_pruned": "SELECT q.vec_id AS query_id, (SELECT count(*) FROM embeddings) AS rows, true AS pruned FROM embeddings q WHERE q.vec_id % 100 = 0",
        "rabitq_two_pass_default": f"WITH c AS ({_CENTROIDS}), {_HITS} {_top(_BY_NPROBE + '3')}",
        "ground_truth": f"SELECT query_id, rank, id FROM ({_top(_ALL('l2'))})",
        "code_bytes": f"WITH c AS ({_CENTROIDS}), d AS ({own}) SELECT cluster_id, vec_id, round(sqrt(d2), 6) AS norm FROM d",
        "merge_owed": f"WITH {_TINY} SELECT (SELECT count(*) FROM tiny) + (SELECT count(*) FROM stats WHERE count = 0) > 0 AS owed",
        "dense_scores": f"WITH {_AFFINE.format(low='-128', high='127')} SELECT q.vec_id AS query_id, b.vec_id AS id, round(-greatest({_dot('q.embedding', 'q.embedding')} + {_dot('b.r', 'b.r')} - 2 * {_dot('q.embedding', 'b.r')}, 0.0), 6) AS score FROM back b, embeddings q WHERE q.vec_id % 100 = 0",
        "i8_codec_roundtrip": "SELECT vec_id, pos - 1 AS pos, greatest(-128.0, least(127.0, round(embedding[pos]::DOUBLE * 400)))::DOUBLE + 0.0 AS x FROM (SELECT *, unnest(range(1, 65)) AS pos FROM embeddings)",
        "centroid_delta": f"WITH c AS ({_CENTROIDS}), p AS (SELECT cluster_id AS slot_id, list_transform(centroid, lambda x: round(x, 6)) AS v FROM c), w AS ({_means(_LATER)}), n AS (SELECT cluster_id AS slot_id, list_transform(centroid, lambda x: round(x, 6)) AS v FROM w), d AS (SELECT n.slot_id, n.v FROM n LEFT JOIN p USING (slot_id) WHERE p.v IS DISTINCT FROM n.v) SELECT row_number() OVER (ORDER BY slot_id)::BIGINT AS seq, slot_id, round(list_sum(v), 4) AS vec_sum FROM d UNION ALL SELECT (SELECT count(*) FROM d) + 1, 8, NULL",
        "apply_centroid_delta": f"WITH w AS ({_means(_LATER)}) SELECT cluster_id AS slot_id, pos - 1 AS pos, round(centroid[pos], 6) AS x FROM (SELECT *, unnest(range(1, 65)) AS pos FROM w)",
        "balanced_split_step": f"WITH a AS ({_means('SELECT *, label::BIGINT AS cluster_id FROM embeddings WHERE vec_id % 2 = 0')}), b AS ({_means('SELECT *, label::BIGINT AS cluster_id FROM embeddings WHERE vec_id % 2 = 1')}), p AS (SELECT e.label::BIGINT AS cluster_id, e.vec_id, round({_l2('e.embedding', 'a.centroid')} - {_l2('e.embedding', 'b.centroid')}, 9) AS pull FROM embeddings e JOIN a ON a.cluster_id = e.label JOIN b ON b.cluster_id = e.label), r AS (SELECT *, count(*) OVER w AS n, sum((pull < 0)::INT) OVER w AS l, row_number() OVER (PARTITION BY cluster_id ORDER BY pull, vec_id) AS place FROM p WINDOW w AS (PARTITION BY cluster_id)) SELECT cluster_id, vec_id, CASE WHEN place <= least(greatest(l, ceil(n / 4.0)), n - ceil(n / 4.0)) THEN 0 ELSE 1 END::BIGINT AS side FROM r",
        "rabitq_norms": f"WITH c AS ({_CENTROIDS}), d AS ({own}) SELECT cluster_id, vec_id, round(sqrt(d2), 6) AS norm FROM d",
        "bigann_scan": f"SELECT vec_id, {_dot('embedding', 'embedding')} AS norm_sq FROM embeddings",
    }
