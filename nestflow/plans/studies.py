"""Whole studies as plans over the operators: a task table, resume by commit markers, and from graphs to interval features to evaluated predictions."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seeds
from ..functions.seeds import derive_seed
from ..operators import evaluate, generate, graph, harmonic, homology, perturb, svm, vectorize
from ..stages import Stages
from .config import StudyConfig


def tasks(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """The cross of short lists, a column each, and the task's number in that order."""
    out = spark.range(1).drop("id")
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    from pyspark.sql import Window

    return out.withColumn("task", F.row_number().over(Window.orderBy(*axes)) - 1)


def remaining(plan: DataFrame, committed: DataFrame) -> DataFrame:
    return plan.join(committed.select("task"), "task", "left_anti")


def requests(spark: SparkSession, model: str, n: int, m: int, params: dict[str, float], graphs: int, base_seed: int) -> DataFrame:
    """Requests for generate(): seeds depend on the graph's number alone, so parts can be made again."""
    seed = lambda domain, i: seeds.signed(derive_seed(base_seed, seeds.DOMAINS[domain], (i,)))
    rows = [(f"{model}-{i}", model, n, m, seed("graph_latent", i), seed("graph_sampling", i), params) for i in range(graphs)]
    return spark.createDataFrame(rows, "g string, model string, n int, m int, latent_seed long, sampling_seed long, params map<string,double>")


def interval_features(edges: DataFrame, spec: list[tuple]) -> DataFrame:
    """obs, idx, re, im of filtered graphs (g, u, v, time): complex, persistence, harmonic coordinates; zeros for graphs without classes."""
    atoms = homology.h1(graph.clique_complex(edges))
    z = harmonic.coordinates(atoms, spec)
    return harmonic.with_empty(z, edges.select(F.col("g").alias("obs")), spec)


def cohesion_filtered(edges: DataFrame) -> DataFrame:
    """Edges with time by clique cohesion. They are read many times, so they are written once."""
    edges = Stages(edges.sparkSession, "cohesion").keep(edges.select("g", "u", "v"))
    return graph.cohesion_filtration(graph.cohesion(edges, graph.trussness(edges)))


def graph_vectors(edges: DataFrame, config: StudyConfig) -> DataFrame:
    """(variant, obs, vector) of filtered graphs: harmonic coordinates, landscape, image and graph statistics.

    Ranges of landscape and image are [0, 1], where filtration times lie, so nothing is fitted on held-out graphs.
    """
    atoms = Stages(edges.sparkSession, "vectors").keep(homology.h1(graph.clique_complex(edges)))
    every = edges.select(F.col("g").alias("obs")).distinct()
    spec = _spec(config)
    z = harmonic.with_empty(harmonic.coordinates(atoms, spec), every, spec)
    as_vector = lambda df, *order: df.groupBy("obs").agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, "value"))), lambda x: x["value"]).alias("vector"))
    w, h = config.image_size
    s = graph.graph_statistics(edges)
    return named({
        "harmonic": harmonic.vectors(z),
        "landscape": as_vector(vectorize.landscape(atoms, every, config.landscapes, vectorize.landscape_grid(0.0, 1.0, config.resolution)), "layer", "point"),
        "image": as_vector(vectorize.image(atoms, every, vectorize.image_pixels((0.0, 1.0, 0.0, 1.0), w, h), config.bandwidth), "pixel"),
        "statistics": s.select(F.col("g").alias("obs"), F.array("density", "mean_degree", "clustering").alias("vector")),
    })


def named(parts: dict, name: str = "variant") -> DataFrame:
    """All parts, with their keys in a column."""
    out = None
    for key, df in parts.items():
        one = df.select(F.lit(key).alias(name), *df.columns)
        out = one if out is None else out.unionByName(one)
    return out


def evaluate_vectors(vectors: DataFrame, labels: DataFrame, config: StudyConfig) -> DataFrame:
    """variant, id, outer_fold, label, prediction, cost of (variant, obs, vector) and (id, label, stratum), by nested cross-validation of each variant; its folds depend on ids and strata alone, so variants of the same samples share them."""
    folds = evaluate.nested_folds(labels, config.outer_folds, config.inner_folds, seed=config.seed)
    rows = folds.join(labels, "id").join(vectors, F.col("id") == F.col("obs")).select("variant", "id", "label", "vector", "outer_fold", "inner_fold")
    return Stages(vectors.sparkSession, "predictions").keep(svm.nested_cross_validate(rows, config.costs, ("variant",)))


def summary(predictions: DataFrame, config: StudyConfig, by: tuple[str, ...] = ("variant",)) -> DataFrame:
    """(by,) accuracy and macro_f1 of pooled held-out predictions, and the bootstrap interval of the accuracy."""
    p = predictions.withColumn("stratum", F.col("label"))
    b = evaluate.bootstrap(p, config.replicates, config.seed & 0x7FFFFFFF, config.level, by=by).where("metric = 'accuracy'").select(*by, "lower", "upper")
    return evaluate.metrics(p, by).join(b, list(by))


def sample_graphs(spark: SparkSession, models: dict[str, dict[str, float]], config: StudyConfig, graphs: int = 1) -> tuple[DataFrame, DataFrame]:
    """(edges with steps and times, members): the graphs of all models, and (batch, obs, label): ``graphs_per_class`` batches of each model of ``graphs`` graphs each."""
    asks = None
    for i, (model, params) in enumerate(models.items()):
        r = requests(spark, model, config.vertices, config.edges, params, config.graphs_per_class * graphs, config.seed + i)
        asks = r if asks is None else asks.unionByName(r)
    number = F.regexp_extract("g", "([0-9]+)$", 1).cast("int")
    edges = Stages(spark, "graphs").keep(graph.rank_filtration(generate.generate(asks)))
    members = asks.select(F.concat_ws("/", "model", F.floor(number / graphs)).alias("batch"), F.col("g").alias("obs"), F.col("model").alias("label"))
    return edges, members


def labelled_graphs(edges: DataFrame, graphs: int = 1) -> tuple[DataFrame, DataFrame]:
    """The same of given graphs (g, label, number, u, v, formation, support): batches are of ``graphs`` graphs of one label with neighbouring numbers; a last one may have fewer."""
    kept = Stages(edges.sparkSession, "graphs").keep(graph.rank_filtration(edges))
    members = kept.select("g", "label", "number").distinct().select(F.concat_ws("/", "label", F.floor(F.col("number") / graphs)).alias("batch"), F.col("g").alias("obs"), "label")
    return kept.select("g", "u", "v", "formation", "support", "step", "time"), members


def _spec(config: StudyConfig) -> list[tuple]:
    return seeds.feature_spec(seeds.character_bank(config.characters, config.seed), config.features)


def batch_features(atoms: DataFrame, members: DataFrame, spec: list[tuple]) -> DataFrame:
    """obs, idx, re, im of every member's diagram; zeros for empty ones."""
    return harmonic.with_empty(harmonic.coordinates(atoms, spec), members, spec)


def _labels(members: DataFrame) -> DataFrame:
    return members.select(F.col("batch").alias("id"), "label").distinct().withColumn("stratum", F.col("label"))


def _vectors(means: DataFrame) -> DataFrame:
    """(obs, vector) from (batch, idx, re, im)."""
    return harmonic.vectors(means, "batch").withColumnRenamed("batch", "obs")


def vector_study(edges: DataFrame, members: DataFrame, config: StudyConfig) -> DataFrame:
    """method, accuracy, macro_f1, lower, upper: can graphs of the labels be told apart by their vectors?"""
    labels = members.select(F.col("obs").alias("id"), "label", F.col("label").alias("stratum"))
    return summary(evaluate_vectors(graph_vectors(edges, config), labels, config), config).withColumnRenamed("variant", "method")


def ablation_study(edges: DataFrame, members: DataFrame, config: StudyConfig) -> DataFrame:
    """method, accuracy, macro_f1, lower, upper of batches of graphs: all coordinates; the linear ones alone; relationships without their order; relationships with another diagram of the batch.

    A batch of one graph has no other diagram, so it takes no part in the last.
    """
    spec = _spec(config)
    atoms = Stages(edges.sparkSession, "ablation").keep(homology.h1(graph.clique_complex(edges)))
    linear = seeds.linear_spec(seeds.character_bank(config.characters, config.seed), config.features)
    partners = harmonic.cyclic_partners(members)
    fill = lambda z, f, m=members: harmonic.batch_mean(harmonic.with_empty(z, m, f), m)
    several = members.join(partners.select("obs"), "obs", "left_semi")
    kinds = {
        "full": fill(harmonic.coordinates(atoms, spec), spec), "linear": fill(harmonic.coordinates(atoms, linear), linear), "no preorder": fill(harmonic.no_order(atoms, spec), spec),
        "cross observation": fill(harmonic.cross_observation(atoms, partners.select("obs", "other"), spec), spec, several),
    }
    return summary(evaluate_vectors(named({k: _vectors(z) for k, z in kinds.items()}), _labels(members), config), config).withColumnRenamed("variant", "method")


def batch_size_study(edges: DataFrame, members: DataFrame, config: StudyConfig, sizes: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """size, accuracy, macro_f1, lower, upper: means over the first graphs of each batch; coordinates are made once."""
    stages = Stages(edges.sparkSession, "sizes")
    z = batch_features(stages.keep(homology.h1(graph.clique_complex(edges))), members, _spec(config))
    z = stages.keep(harmonic.by_prefix(z, members, list(sizes)))
    v = named({n: _vectors(z.where(F.col("size") == n).drop("size")) for n in sizes})
    return summary(evaluate_vectors(v, _labels(members), config), config).withColumnRenamed("variant", "size")


def character_study(edges: DataFrame, members: DataFrame, config: StudyConfig, counts: tuple[int, ...] = (4, 8, 16)) -> DataFrame:
    """features, accuracy, macro_f1, lower, upper for several numbers of features and as many characters; smaller banks are beginnings of the largest."""
    atoms, bank = Stages(edges.sparkSession, "characters").keep(homology.h1(graph.clique_complex(edges))), seeds.character_bank(max(counts), config.seed)
    v = named({n: _vectors(harmonic.batch_mean(batch_features(atoms, members, seeds.feature_spec(bank[:n], n)), members)) for n in counts})
    return summary(evaluate_vectors(v, _labels(members), config), config).withColumnRenamed("variant", "features")


def perturbed(edges: DataFrame, kind: str, severity: float, seed: int) -> DataFrame:
    """Filtered graphs (g, u, v, time) after one of the four perturbations."""
    e = edges.select("g", "u", "v", "step", "time")
    if kind == "deletion":
        return perturb.delete_edges(e, severity, perturb.draw(seed, "g", "u", "v")).select("g", "u", "v", "time")
    if kind == "insertion":
        return perturb.insert_random_edges(e, severity, seed).select("g", "u", "v", "time")
    if kind == "swap":
        return perturb.swap_edges(e, severity, seed).select("g", "u", "v", "time")
    if kind == "noise":
        return perturb.jitter(e, severity, perturb.normal(seed, "g", "u", "v")).select("g", "u", "v", "time")
    raise ValueError(f"perturbation {kind!r}")


def robustness_study(edges: DataFrame, members: DataFrame, config: StudyConfig, kinds: tuple[str, ...] = ("deletion", "insertion", "swap", "noise"), severities: tuple[float, ...] = (0.1,), realizations: int = 2) -> DataFrame:
    """perturbation, severity, and for each metric observed, mean, sd, lower, upper: of classification on perturbed graphs (first), on the graphs as they are (second) and of the difference.

    Each realization is learnt and tested on its own perturbed graphs, in the folds of the unperturbed study; intervals are hierarchical. All perturbed graphs go from complex to prediction together.
    """
    spark, spec = edges.sparkSession, _spec(config)
    stages = Stages(spark, "robustness")
    graphs = {"": edges.select("g", "u", "v", "time")}
    for k, kind in enumerate(kinds):
        for severity in severities:
            for r in range(realizations):
                seed = derive_seed(config.seed, seeds.DOMAINS["robustness"], (k, int(severity * 1000), r)) & 0x7FFFFFFF
                graphs[f"{kind}|{severity}|{r}"] = perturbed(edges, kind, severity, seed)
    own = lambda c: F.concat_ws("|", "variant", c)
    every = stages.keep(named(graphs).select(own("g").alias("g"), "u", "v", "time"))
    in_each = named({k: members for k in graphs}).select(own("batch").alias("batch"), own("obs").alias("obs"))
    means = harmonic.batch_mean(batch_features(stages.keep(homology.h1(graph.clique_complex(every))), in_each, spec), in_each)
    v = _vectors(means).select(F.regexp_extract("obs", r"^((?:[^|]*\|[^|]*\|[^|]*)?)\|", 1).alias("variant"), F.regexp_extract("obs", r"([^|]*)$", 1).alias("obs"), "vector")
    p = evaluate_vectors(v, _labels(members), config)
    base = p.where("variant = ''").select("id", F.col("prediction").alias("second"))
    part = F.split("variant", r"\|")
    rows = p.where("variant <> ''").join(base, "id").select(part[0].alias("perturbation"), part[1].cast("double").alias("severity"), part[2].cast("int").alias("realization"), "id", "label", "prediction", "second", F.col("label").alias("stratum"))
    rows, out = stages.keep(rows), None
    for kind in kinds:
        for severity in severities:
            one = evaluate.hierarchical_bootstrap(rows.where((F.col("perturbation") == kind) & (F.col("severity") == severity)), config.replicates, config.seed & 0x7FFFFFFF, config.level)
            one = one.select(F.lit(kind).alias("perturbation"), F.lit(float(severity)).alias("severity"), *one.columns)
            out = one if out is None else out.unionByName(one)
    return out


def collection_study(graphs: DataFrame, edges: DataFrame, config: StudyConfig, sizes: tuple[int, ...] = (1, 2)) -> DataFrame:
    """size, method, accuracy, macro_f1, lower, upper of labelled graphs (g, label) and their edges (g, u, v, ..): edges come by clique cohesion, vectors are means over bags of graphs of one class.

    The other method says the commonest class of the training bags. A class without a bag is an error.
    """
    stages = Stages(edges.sparkSession, "collection")
    samples, spec = graphs.select(F.col("g").alias("id"), "label"), _spec(config)
    timed = stages.keep(cohesion_filtered(stages.keep(edges.select("g", "u", "v"))).select("g", "u", "v", "time"))
    z = stages.keep(harmonic.with_empty(harmonic.coordinates(homology.h1(graph.clique_complex(timed)), spec), samples.select(F.col("id").alias("obs")), spec))
    bagged = named({n: evaluate.bags(evaluate.need_bags(samples, n), n, seed=config.seed & 0x7FFFFFFF) for n in sizes}, "size")
    members = stages.keep(bagged.select("size", F.concat_ws("/", "size", "label", "bag").alias("batch"), F.col("id").alias("obs"), "label"))
    labels = members.select("size", F.col("batch").alias("id"), "label").distinct()
    v = _vectors(harmonic.batch_mean(z, members)).join(labels.select(F.col("id").alias("obs"), F.col("size").alias("variant")), "obs")
    p = evaluate_vectors(v, labels.select("id", "label", F.concat_ws("/", "size", "label").alias("stratum")), config).withColumnRenamed("variant", "size")
    n = p.groupBy("size", "outer_fold", "label").count()
    # bags that are not held out in a fold are learnt from there
    folds = p.select("size", "outer_fold").distinct().withColumnRenamed("outer_fold", "held")
    learnt = folds.join(n, "size").where(F.col("held") != F.col("outer_fold")).groupBy("size", "held", "label").agg(F.sum("count").alias("count"))
    common = learnt.groupBy("size", "held").agg(F.min(F.struct((-F.col("count")).alias("n"), "label")).alias("x")).select("size", F.col("held").alias("outer_fold"), F.col("x.label").alias("prediction"))
    m = p.drop("prediction").join(common, ["size", "outer_fold"])
    both = named({"harmonic": p.select("size", "id", "label", "prediction"), "majority": m.select("size", "id", "label", "prediction")}, "method")
    return summary(both, config, ("size", "method")).select("size", "method", "accuracy", "macro_f1", "lower", "upper")
