"""Queries on reports. Return flags stand for architectures, ship modes and brands for cells, line numbers for repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.catalog import query
from lodestone.functions.symbols import BYTE_IDS
from lodestone.operators import reports
from lodestone.operators.shards import byte_tokens
from lodestone.session import table


def r9(c: str | Column, name: str | None = None) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 9).alias(name or c)


@query("""
    WITH s AS (SELECT p_brand AS variant, l_linenumber AS seed, avg(l_extendedprice) AS loss, CASE WHEN p_brand < 'Brand#2' THEN avg(l_quantity) WHEN l_linenumber < 4 THEN avg(l_quantity) END AS memory
               FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
    SELECT variant, count(*) AS seeds, round(avg(loss), 6) AS mean, round(coalesce(stddev_samp(loss), 0), 6) AS deviation,
           CASE WHEN count(memory) = count(*) THEN round(avg(memory), 9) END AS optional_mean, CASE WHEN count(memory) = count(*) THEN round(coalesce(stddev_samp(memory), 0), 9) END AS optional_deviation
    FROM s GROUP BY variant""")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    memory = F.when((F.col("variant") < "Brand#2") | (F.col("seed") < 4), F.col("quantity"))
    seeds = rows.groupBy(F.col("p_brand").alias("variant"), F.col("l_linenumber").alias("seed")).agg(F.avg("l_extendedprice").alias("loss"), F.avg("l_quantity").alias("quantity")).withColumn("memory", memory)
    out = reports.summary(seeds, "variant", "loss", "memory")
    return out.select("variant", "seeds", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), r9("optional_mean"), r9("optional_deviation"))


_CELLS = "c AS (SELECT l_returnflag AS architecture, 'cell-' || (l_suppkey % 5) AS cell, l_linenumber AS repetition, avg(l_extendedprice) AS throughput, avg(l_tax) AS loss_delta, avg(l_discount) AS gradient_delta FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 3")
    cell = F.concat(F.lit("cell-"), (F.col("l_suppkey") % 5).cast("string")).alias("cell")
    return rows.groupBy(F.col("l_returnflag").alias("architecture"), cell, F.col("l_linenumber").alias("repetition")).agg(F.avg("l_extendedprice").alias("throughput"), F.avg("l_tax").alias("loss_delta"), F.avg("l_discount").alias("gradient_delta"))


@query(f"""
    WITH {_CELLS}, m AS (SELECT architecture, cell, median(throughput) AS med, (max(throughput) - min(throughput)) / median(throughput) AS spread, max(loss_delta) AS ld, max(gradient_delta) AS gd FROM c GROUP BY ALL),
         b AS (SELECT architecture, med AS bmed, spread AS bspread FROM m WHERE cell = 'cell-0'),
         j AS (SELECT *, med / bmed AS speedup, spread <= 0.05 AND bspread <= 0.05 AS stable, CASE WHEN cell = 'cell-0' THEN 0 ELSE ld END <= 0.0402 AND CASE WHEN cell = 'cell-0' THEN 0 ELSE gd END <= 0.0503 AS parity FROM m JOIN b USING (architecture))
    SELECT architecture, cell, round(med, 6) AS median, round(spread, 9) AS spread, round(bmed, 6) AS baseline_median, round(bspread, 9) AS baseline_spread, round(speedup, 9) AS speedup, stable, parity,
           cell <> 'cell-0' AND parity AND stable AND speedup >= 1.0 AS promoted FROM j""")
def calibration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.calibration(_cells(spark, sf_dir), "cell-0", 1.0, 0.05, {"loss_delta": 0.0402, "gradient_delta": 0.0503})
    return out.select("architecture", "cell", F.round("median", 6).alias("median"), r9("spread"), F.round("baseline_median", 6).alias("baseline_median"), r9("baseline_spread"), r9("speedup"), "stable", "parity", "promoted")


@query(f"""
    WITH {_CELLS}, p AS (SELECT *, CASE WHEN cell = 'cell-3' AND architecture = 'N' THEN 'other' ELSE 'plan' END AS plan FROM c),
         b AS (SELECT architecture, repetition, throughput, plan FROM p WHERE cell = 'cell-0' AND repetition <> 2)
    SELECT p.architecture, p.cell, p.repetition, round(p.throughput, 6) AS throughput, round(b.throughput, 6) AS baseline_value, b.plan IS NULL AS missing_baseline, b.plan IS NOT NULL AND b.plan <> p.plan AS incompatible
    FROM p LEFT JOIN b ON p.architecture = b.architecture AND p.repetition = b.repetition WHERE p.cell <> 'cell-0'""")
def baseline_requirement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate needs the baseline of its repetition and plan; the second one's is taken away, and one cell is of another plan."""
    rows = _cells(spark, sf_dir).filter("not (cell = 'cell-0' and repetition = 2)").withColumn("plan", F.expr("if(cell = 'cell-3' and architecture = 'N', 'other', 'plan')"))
    out = reports.with_baseline(rows, "cell-0", "architecture", "repetition", bound=["plan"])
    return out.select("architecture", "cell", "repetition", F.round("throughput", 6).alias("throughput"), F.round("baseline_value", 6).alias("baseline_value"), "missing_baseline", "incompatible")


@query(f"WITH {_CELLS} SELECT c.architecture, c.cell, c.repetition, round(c.throughput / b.throughput, 9) AS ratio FROM c JOIN c b ON b.architecture = c.architecture AND b.repetition = c.repetition AND b.cell = 'cell-0' WHERE c.cell <> 'cell-0'")
def candidate_vs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.with_baseline(_cells(spark, sf_dir), "cell-0", "architecture", "repetition").filter("not missing_baseline")
    return out.select("architecture", "cell", "repetition", r9(F.col("throughput") / F.col("baseline_value"), "ratio"))


@query("""
    WITH p AS (SELECT a AS architecture, 'cell-' || c AS cell, r::INTEGER AS repetition FROM (VALUES ('A'), ('N'), ('R')) x(a), range(0, 6) y(c), range(1, 4) z(r)),
         d AS (SELECT DISTINCT l_returnflag AS architecture, 'cell-' || (l_suppkey % 5) AS cell, l_linenumber AS repetition FROM lineitem WHERE l_linenumber <= 4)
    SELECT coalesce(p.architecture, d.architecture) AS architecture, coalesce(p.cell, d.cell) AS cell, coalesce(p.repetition, d.repetition) AS repetition,
           CASE WHEN p.cell IS NULL THEN 'unplanned' WHEN d.cell IS NULL THEN 'missing' ELSE 'done' END AS state
    FROM p FULL JOIN d ON p.architecture = d.architecture AND p.cell = d.cell AND p.repetition = d.repetition""")
def plan_result_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["architecture", "cell", "repetition"]
    plan = reports.plan_matrix(spark, architecture=["A", "N", "R"], cell=[f"cell-{k}" for k in range(6)], repetition=[1, 2, 3]).withColumn("repetition", F.col("repetition").cast("int")).withColumn("_p", F.lit(1))
    rows = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 4")
    done = rows.select(F.col("l_returnflag").alias("architecture"), F.concat(F.lit("cell-"), (F.col("l_suppkey") % 5).cast("string")).alias("cell"), F.col("l_linenumber").alias("repetition")).distinct().withColumn("_d", F.lit(1))
    state = F.when(F.col("_p").isNull(), "unplanned").when(F.col("_d").isNull(), "missing").otherwise("done")
    return plan.join(done, key, "full").select(*key, state.alias("state"))


@query("SELECT a AS architecture, s AS seed, c::BIGINT AS repetition FROM (VALUES ('dense'), ('mamba2'), ('diffusion')) x(a), (VALUES (1337::BIGINT), (2027), (3407)) y(s), range(1, 4) z(c)")
def plan_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.plan_matrix(spark, architecture=["dense", "mamba2", "diffusion"], seed=[1337, 2027, 3407], repetition=[1, 2, 3])


@query("""
    WITH r AS (SELECT l_orderkey AS cell, l_returnflag, CASE WHEN l_linenumber > 2 THEN l_linestatus END AS l_linestatus FROM lineitem)
    SELECT cell, count(DISTINCT l_returnflag) = 1 AS same_l_returnflag, count(DISTINCT coalesce(l_linestatus, 'none')) = 1 AS same_l_linestatus FROM r GROUP BY 1""")
def constancy_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two lines of an order have no status: with others that is a second value, alone it is the only one."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell"), "l_returnflag", F.when(F.col("l_linenumber") > 2, F.col("l_linestatus")).alias("l_linestatus"))
    return reports.constant(rows, "cell", "l_returnflag", "l_linestatus")


@query("SELECT l_orderkey AS variant, count(DISTINCT l_linenumber) AS seeds FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) <> 3")
def seed_count_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants that don't have exactly three seeds."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("variant")).agg(F.countDistinct("l_linenumber").alias("seeds")).filter("seeds <> 3")


_PAIRS = "p AS (SELECT l_returnflag AS role, -l_tax AS chosen, -l_discount AS rejected, l_linenumber AS chosen_tokens, l_quantity AS rejected_tokens, l_quantity > 45 AS truncated FROM lineitem)"


@query(f"""
    WITH {_PAIRS} SELECT role, count(*) AS pairs, round(count(*) FILTER (WHERE chosen > rejected) / count(*), 9) AS accuracy, round(sum(chosen) / count(*), 9) AS mean_chosen, round(sum(rejected) / count(*), 9) AS mean_rejected,
           round((sum(chosen) - sum(rejected)) / count(*), 9) AS mean_margin, round(sum(chosen_tokens) / count(*), 9) AS mean_chosen_tokens, round(sum(rejected_tokens) / count(*), 9) AS mean_rejected_tokens,
           count(*) FILTER (WHERE truncated) AS truncated_pairs, round(count(*) FILTER (WHERE truncated) / count(*), 9) AS truncation_rate FROM p GROUP BY role""")
def preference_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("role"), (-F.col("l_tax")).alias("chosen"), (-F.col("l_discount")).alias("rejected"), F.col("l_linenumber").alias("chosen_tokens"), F.col("l_quantity").alias("rejected_tokens"), (F.col("l_quantity") > 45).alias("truncated"))
    out = reports.preference_summary(rows, "role")
    return out.select(*(c if c in ("role", "pairs", "truncated_pairs") else r9(c) for c in out.columns))


@query("SELECT l_returnflag AS run, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS mean_loss, sum(l_quantity) AS tokens, round(exp(sum(l_discount * l_quantity) / sum(l_quantity)), 9) AS perplexity FROM lineitem GROUP BY 1")
def weighted_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.perplexity(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "run"), "run", "l_discount", "l_quantity")
    return out.select("run", r9("mean_loss"), "tokens", r9("perplexity"))


@query("""
    SELECT l_returnflag AS run, round(sum(l_discount * l_linenumber) / sum(l_linenumber), 9) AS loss, round(sum(l_tax * l_quantity) / sum(l_quantity), 9) AS masked_loss,
           round(sum(l_linenumber) / sum(l_quantity), 9) AS masked_accuracy, sum(l_quantity) AS masked, sum(l_linenumber)::BIGINT AS examples FROM lineitem GROUP BY 1""")
def diffusion_eval_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("run"), F.col("l_discount").alias("weighted_loss"), F.col("l_tax").alias("token_loss"), F.col("l_quantity").alias("masked"), F.col("l_linenumber").alias("correct"), F.col("l_linenumber").alias("examples"))
    return reports.diffusion_rollup(rows, "run").select("run", r9("loss"), r9("masked_loss"), r9("masked_accuracy"), "masked", "examples")


_ERRORS = "e AS (SELECT vec_id, i, embedding[i]::DOUBLE AS x, embedding[i]::DOUBLE * (1 + (vec_id % 7) * 1e-3) AS y, label FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    return rows.withColumn("y", F.col("x") * (1 + (F.col("vec_id") % 7) * F.lit(1e-3)))


@query(f"""
    WITH {_ERRORS}, b AS (SELECT vec_id, i, x, CASE WHEN vec_id % 50 = 3 AND i = 1 THEN NULL ELSE y END AS y, vec_id % 50 = 3 AND i = 1 AS gone FROM e)
    SELECT vec_id, count(*) FILTER (WHERE gone) AS unmatched, round(max(abs(y - x)), 9) AS max_error, count(*) FILTER (WHERE abs(y - x) > 1e-4 + 2e-3 * abs(x)) AS violations, count(*) FILTER (WHERE y = x) AS equal,
           round(max(abs(y - x) / (1e-4 + 2e-3 * abs(x))), 9) AS max_ratio, count(*) AS values FROM b GROUP BY vec_id""")
def tensor_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _errors(spark, sf_dir)
    expected = rows.select("vec_id", "i", F.col("x").alias("value"))
    actual = rows.filter("not (vec_id % 50 = 3 and i = 0)").select("vec_id", "i", F.col("y").alias("value"))
    out = reports.tolerance(expected, actual, ["vec_id", "i"], "vec_id", 1e-4, 2e-3)
    return out.select("vec_id", "unmatched", r9("max_error"), "violations", "equal", r9("max_ratio"), "values")


@query(f"WITH {_ERRORS} SELECT label, round(sqrt(sum((y - x) ** 2)) / sqrt(sum(x ** 2)), 9) AS relative_l2, round(max(abs(y - x)), 9) AS max_error FROM e GROUP BY label")
def relative_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.relative_l2(_errors(spark, sf_dir), "label", "x", "y").select("label", r9("relative_l2"), r9("max_error"))


@query(f"""
    WITH {_ERRORS}, s AS (SELECT label, count(*) AS n, sum(x * x) AS w, sum((y / 10) * (y / 10)) AS g, sum((y - x) ** 2) AS u, sum(y * y) AS c, sum(x * (y - x)) AS xu FROM e GROUP BY label)
    SELECT label, n AS values, round(sqrt(w / n), 9) AS weight_rms, round(sqrt(g / n), 9) AS gradient_rms, round(sqrt(u / n), 9) AS update_rms, round(sqrt(u / w), 9) AS effective_rate,
           round(atan2(sqrt(greatest(0.0, u - xu * xu / w)), sqrt(w) + xu / sqrt(w)), 7) AS angular_rate FROM s""")
def group_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _errors(spark, sf_dir).withColumn("g", F.col("y") / 10)
    out = reports.update_rms(rows, "label", "x", "y", "g")
    return out.select("label", "values", r9("weight_rms"), r9("gradient_rms"), r9("update_rms"), r9("effective_rate"), F.round("angular_rate", 7).alias("angular_rate"))


@query("SELECT event_id % 4 AS rank, round(avg(value), 9) AS mean, max(value) AS largest FROM events GROUP BY 1 UNION ALL SELECT NULL, round(avg(value), 9), max(value) FROM events")
def cross_rank_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rank's mean and largest value, and those over all ranks (null)."""
    out = table(spark, sf_dir, "events").rollup((F.col("event_id") % 4).alias("rank")).agg(F.avg("value").alias("mean"), F.max("value").alias("largest"))
    return out.select("rank", r9("mean"), "largest")


@query("""
    WITH b AS (SELECT l_orderkey % 100 AS batch, l_tax - l_discount AS logit FROM lineitem), m AS (SELECT batch, count(*) AS pairs, avg(logit) AS mean_logit, avg((logit > 0)::INT) AS accuracy FROM b GROUP BY batch)
    SELECT count(*) AS batches, sum(pairs)::BIGINT AS pairs, round(sum(mean_logit * pairs) / sum(pairs), 9) AS logit, round(sum(accuracy * pairs) / sum(pairs), 9) AS accuracy FROM m""")
def dpo_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("batch"), (F.col("l_tax") - F.col("l_discount")).alias("logit"))
    m = rows.groupBy("batch").agg(F.count("*").alias("pairs"), F.avg("logit").alias("mean_logit"), F.avg((F.col("logit") > 0).cast("int")).alias("accuracy"))
    mean = lambda c: F.sum(F.col(c) * F.col("pairs")) / F.sum("pairs")
    return m.agg(F.count("*").alias("batches"), F.sum("pairs").alias("_n"), r9(mean("mean_logit"), "logit"), r9(mean("accuracy"), "accuracy")).withColumnRenamed("_n", "pairs")


@query("""
    WITH a AS (SELECT doc_id AS ordinal, sha256(text) AS content FROM documents WHERE doc_id % 101 <> 5), b AS (SELECT doc_id AS ordinal, CASE WHEN doc_id % 97 = 0 THEN 'x' ELSE sha256(text) END AS stated FROM documents WHERE doc_id % 103 <> 8)
    SELECT coalesce(a.ordinal, b.ordinal) AS ordinal, content = stated AS matches, CASE WHEN a.ordinal IS NULL THEN 'left missing' WHEN b.ordinal IS NULL THEN 'right missing' END AS problem FROM a FULL JOIN b ON a.ordinal = b.ordinal""")
def strict_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and their stated hashes by ordinal."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), F.sha2("text", 256).alias("h"))
    left = docs.filter("ordinal % 101 <> 5").withColumnRenamed("h", "content")
    right = docs.filter("ordinal % 103 <> 8").select("ordinal", F.expr("case when ordinal % 97 = 0 then 'x' else h end").alias("stated"))
    return reports.strict_zip(left, right, "ordinal").select("ordinal", (F.col("content") == F.col("stated")).alias("matches"), "problem")


@query("""
    WITH v AS (SELECT p_brand AS variant, count(*) AS jobs, min(p_partkey % 2) AS model, min(p_partkey % 3) AS shards FROM part WHERE p_size = 10 GROUP BY 1),
         e AS (SELECT p_brand AS variant, count(*) AS evaluations, min(p_partkey % 2) AS model, min(p_partkey % 3) AS shards FROM part WHERE p_size = 20 GROUP BY 1),
         g AS (SELECT p_brand AS variant, count(*) AS generations, min(p_partkey % 2) AS model, min(p_partkey % 3) AS shards FROM part WHERE p_size = 30 GROUP BY 1),
         j AS (SELECT variant, jobs, coalesce(evaluations, 0) AS evaluations, coalesce(generations, 0) AS generations,
                      v.model IS NOT DISTINCT FROM e.model AND v.model IS NOT DISTINCT FROM g.model AND v.shards IS NOT DISTINCT FROM e.shards AND v.shards IS NOT DISTINCT FROM g.shards AS bound
               FROM v LEFT JOIN e USING (variant) LEFT JOIN g USING (variant))
    SELECT *, bound AND jobs = 1 AND evaluations = 1 AND generations = 1 AS complete FROM j""")
def recommended_downstream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with their evaluation and generation records, complete where there is one of each and they bind; parts of three sizes stand for them."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("variant"), (F.col("p_partkey") % 2).alias("model"), (F.col("p_partkey") % 3).alias("shards"), "p_size")
    return reports.downstream(*(part.filter(F.col("p_size") == k) for k in (10, 20, 30)), "variant", ["model", "shards"])


@query("SELECT l_orderkey, l_linenumber, o_totalprice AS reference FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def logprob_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached reference values by record index, many rows to one."""
    cache = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("reference"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(cache, "l_orderkey")


@query("""
    WITH RECURSIVE e AS (SELECT doc_id AS c, CASE WHEN doc_id > 0 THEN doc_id // 2 END AS p FROM documents),
         chain(origin, depth, node) AS (SELECT c, 0, c FROM e UNION ALL SELECT origin, depth + 1, p FROM chain JOIN e ON node = c WHERE p IS NOT NULL)
    SELECT origin, depth, node FROM chain""")
def lineage_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ancestors of every document; a document's parent has half its id, so that all chains together stay in proportion."""
    edges = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") > 0, F.floor(F.col("doc_id") / 2)).alias("parent"))
    return reports.lineage(edges, "doc_id", "parent")


@query("SELECT o_orderkey, o_orderstatus AS token, CASE o_orderstatus WHEN 'F' THEN 45 WHEN 'O' THEN 54 WHEN 'P' THEN 55 END AS token_id FROM orders")
def token_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte tokens by a table of the ASCII bytes, which is sent to every task."""
    names = spark.createDataFrame([(BYTE_IDS[b], chr(b)) for b in range(128)], "token_id int, token string")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("token")).join(F.broadcast(names), "token").select("o_orderkey", "token", "token_id")


@query("""
    WITH g AS (SELECT p_brand AS name, round(avg(p_retailprice), 6) AS loss, round(avg(p_size), 1) AS throughput FROM part GROUP BY p_brand)
    SELECT *, row_number() OVER (ORDER BY loss, name)::INTEGER AS position, row_number() OVER (ORDER BY throughput DESC, name)::INTEGER AS throughput_rank FROM g""")
def variant_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.round(F.avg("p_retailprice"), 6).alias("loss"), F.round(F.avg("p_size"), 1).alias("throughput"))
    return reports.ranked(groups, "loss", "name", throughput="throughput")


@query("""
    WITH j AS (SELECT c_custkey, c_mktsegment AS a, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS a2, c_nationkey AS b, c_nationkey + (c_custkey % 5 = 0)::INT AS b2 FROM customer)
    SELECT c_custkey, concat_ws(',', CASE WHEN a IS DISTINCT FROM a2 THEN 'segment' END, CASE WHEN b IS DISTINCT FROM b2 THEN 'nation' END) AS differing FROM j""")
def binding_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.expr("case when c_custkey % 3 = 0 then null else c_mktsegment end").alias("segment2"), F.col("c_nationkey").alias("nation"), F.expr("c_nationkey + if(c_custkey % 5 = 0, 1, 0)").alias("nation2"))
    return rows.select("c_custkey", F.array_join(reports.mismatches(rows, [("segment", "segment2"), ("nation", "nation2")]), ",").alias("differing"))


@query("SELECT o_orderkey, CASE WHEN NOT o_totalprice > 1000 THEN 'price' WHEN NOT o_orderstatus IN ('F', 'O') THEN 'status' WHEN NOT year(o_orderdate) < 1998 THEN 'date' END AS failure FROM orders")
def preflight_first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("price", F.col("o_totalprice") > 1000), ("status", F.col("o_orderstatus").isin("F", "O")), ("date", F.year("o_orderdate") < 1998)]
    return table(spark, sf_dir, "orders").select("o_orderkey", reports.first_failure(rules).alias("failure"))


@query("SELECT event_id, event_id % 10 NOT IN (1, 2) AS finite FROM events")
def finite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("event_id") % 10 == 1, float("nan")).when(F.col("event_id") % 10 == 2, float("-inf")).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", (~F.isnan(score) & (F.abs(score) != float("inf"))).alias("finite"))


@query("SELECT source, count(*) AS documents, sum(strlen(text) + 1)::BIGINT AS tokens, sum(strlen(text))::BIGINT AS bytes, sum(n_chars)::BIGINT AS characters, round(sum(strlen(text)) / sum(n_chars), 9) AS bytes_per_character FROM documents GROUP BY source")
def encoding_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.sum(F.octet_length("text")).cast("long")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.size(byte_tokens(F.col("text"))) + 1).cast("long").alias("tokens"), n.alias("bytes"), F.sum("n_chars").alias("characters"), r9(n / F.sum("n_chars"), "bytes_per_character"))
