"""Queries on arrays and closed forms. Embeddings serve as logits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.catalog import query
from lodestone.functions import labels, schedules
from lodestone.operators import tensors
from lodestone.plans.reports import r9
from lodestone.session import table

_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE * 8) AS x FROM embeddings)"
_LSM = "list_transform({x}, lambda a: a - (list_max({x}) + ln(list_sum(list_transform({x}, lambda b: exp(b - list_max({x})))))))"
#: Sequences of ten vectors; the token of a vector is its id modulo 64; half of a sequence is the answer.
_SEQ = "seq AS (SELECT vec_id // 10 AS sequence, vec_id % 10 AS position, (vec_id * 7 % 64)::INTEGER AS token, vec_id % 10 >= 5 AS answer, x, lag(x) OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) AS before FROM v)"


def _scaled() -> Column:
    return F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 8)


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.floor(F.col("vec_id") / 10).alias("sequence"), (F.col("vec_id") % 10).alias("position"), (F.col("vec_id") * 7 % 64).cast("int").alias("token"), (F.col("vec_id") % 10 >= 5).alias("answer"), _scaled().alias("x"))


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(_scaled()).alias("index", "score"))


_LONG = "l AS (SELECT vec_id, (i - 1)::INTEGER AS index, x[i] AS score FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM v))"


@query(f"WITH {_V}, s AS (SELECT vec_id, {_LSM.format(x='x')} AS y FROM v) SELECT vec_id, (unnest(range(1, 65)) - 1)::INTEGER AS index, round(unnest(y), 9) AS value FROM s")
def log_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(tensors.log_softmax(_scaled())).alias("index", "value"))
    return rows.select("vec_id", "index", r9("value"))


@query(f"WITH {_V}, {_SEQ} SELECT sequence, round(avg(-({_LSM.format(x='before')})[token + 1]), 9) AS loss, count(*) AS predicted FROM seq WHERE before IS NOT NULL GROUP BY sequence")
def causal_ce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensors.cross_entropy(_sequences(spark, sf_dir), "sequence", "position", "x", "token").withColumn("loss", F.round("loss", 9))


@query(f"WITH {_V}, {_SEQ} SELECT sequence, round(coalesce(avg(-({_LSM.format(x='before')})[token + 1]) FILTER (WHERE answer), 0), 9) AS loss, count(*) FILTER (WHERE answer) AS predicted FROM seq WHERE before IS NOT NULL GROUP BY sequence")
def assistant_ce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sequences(spark, sf_dir).withColumn("token", F.when(F.col("answer"), F.col("token")).otherwise(-100))
    return tensors.cross_entropy(rows, "sequence", "position", "x", "token").withColumn("loss", F.round("loss", 9))


@query(f"WITH {_V}, {_SEQ} SELECT sequence, round(sum(({_LSM.format(x='before')})[token + 1]), 9) AS logprob, count(*) AS tokens FROM seq WHERE before IS NOT NULL AND answer GROUP BY sequence")
def masked_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensors.masked_logprob(_sequences(spark, sf_dir), "sequence", "position", "x", "token", "answer").withColumn("logprob", F.round("logprob", 9))


@query(f"""
    WITH {_V}, p AS (SELECT vec_id, {_LSM.format(x='x')} AS p, list_reverse({_LSM.format(x='x')}) AS q FROM v)
    SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: exp(p[i]) * (p[i] - q[i]))), 9) AS kl FROM p""")
def forward_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the distribution in reverse order."""
    return table(spark, sf_dir, "embeddings").select("vec_id", r9(tensors.forward_kl(_scaled(), F.reverse(_scaled())), "kl"))


@query("""
    WITH p AS (SELECT l_orderkey, l_linenumber, ((-l_tax * 50 + l_discount * 50) - (-l_quantity / 10 + l_linenumber)) AS margin, 0.1 * (-l_tax * 50 + l_quantity / 10) AS chosen_reward, 0.1 * (-l_discount * 50 + l_linenumber) AS rejected_reward FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN abs(margin) < 1e-12 THEN 0 ELSE round(margin, 9) END AS margin, CASE WHEN abs(0.1 * margin) < 1e-12 THEN 0 ELSE round(0.1 * margin, 9) END AS logit,
           CASE WHEN abs(chosen_reward) < 1e-12 THEN 0 ELSE round(chosen_reward, 9) END AS chosen_reward, CASE WHEN abs(rejected_reward) < 1e-12 THEN 0 ELSE round(rejected_reward, 9) END AS rejected_reward,
           round(CASE WHEN margin >= 0 THEN ln(1 + exp(-0.1 * margin)) ELSE ln(1 + exp(0.1 * margin)) - 0.1 * margin END, 9) AS loss FROM p""")
def dpo_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (-c("l_tax") * 50).alias("policy_chosen"), (-c("l_discount") * 50).alias("policy_rejected"), (-c("l_quantity") / 10).alias("reference_chosen"), (-c("l_linenumber")).cast("double").alias("reference_rejected"))
    plain = lambda x: F.when(F.abs(x) < 1e-12, 0.0).otherwise(F.round(x, 9)).alias(x)  # noqa: E731  no negative zero
    return tensors.dpo(rows, 0.1).select("l_orderkey", "l_linenumber", *map(plain, ("margin", "logit", "chosen_reward", "rejected_reward")), r9("loss"))


#: Draws from hashes: 32 bits of SHA-256 over 2^32.
_U = "(('0x' || substr(sha256({key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_DRAWS = f"""
    d AS (SELECT vec_id, i - 1 AS position, i % 7 <> 0 AS eligible, {_U.format(key="vec_id || ':' || (i - 1)")} AS u, 0.001 + 0.05 * {_U.format(key="'t' || vec_id")} AS t FROM (SELECT vec_id, unnest(range(1, 17)) AS i FROM embeddings)),
    k AS (SELECT *, eligible AND u < t AS hit, bool_or(eligible AND u < t) OVER (PARTITION BY vec_id) AS any_hit, row_number() OVER (PARTITION BY vec_id ORDER BY eligible DESC, u, position) AS place FROM d),
    m AS (SELECT *, hit OR (NOT any_hit AND eligible AND place = 1) AS masked FROM k)"""


def _draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = lambda key: F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("position"))
    rows = rows.select("vec_id", "position", ((F.col("position") + 1) % 7 != 0).alias("eligible"), u(F.concat_ws(":", "vec_id", "position")).alias("u"), (0.001 + 0.05 * u(F.concat(F.lit("t"), F.col("vec_id").cast("string")))).alias("t"))
    return tensors.corrupted(rows, "vec_id", "position", "eligible", "u", "t")


@query(f"WITH {_DRAWS} SELECT vec_id, position, masked FROM m")
def diffusion_corrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _draws(spark, sf_dir).select("vec_id", "position", "masked")


@query(f"WITH {_DRAWS}, e AS (SELECT vec_id, count(*) FILTER (WHERE eligible) AS n, sum((position + 1) / 10.0::DOUBLE / t) FILTER (WHERE masked) AS s FROM m GROUP BY vec_id) SELECT round(avg(s / n), 6) AS loss, count(*) AS groups FROM e WHERE n > 0")
def diffusion_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _draws(spark, sf_dir).withColumn("loss", (F.col("position") + 1) / 10)
    return tensors.diffusion_loss(rows, "vec_id", "eligible", "masked", "loss", "t").select(F.round("loss", 6).alias("loss"), "groups")


@query(f"WITH {_V}, {_LONG}, r AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY round(score, 1) DESC) AS k FROM l) SELECT vec_id, index, round(score, 1) AS score FROM r WHERE k <= 5")
def top_k_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores in tenths, so that ties at the fifth place are common."""
    return tensors.top_k(_long(spark, sf_dir).withColumn("score", F.round("score", 1)), "vec_id", "score", 5)


_TOP_P = """
    s AS (SELECT vec_id, index, score, exp(score - max(score) OVER (PARTITION BY vec_id)) AS e FROM {of}), p AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS probability FROM s),
    c AS (SELECT *, coalesce(sum(probability) OVER (PARTITION BY vec_id ORDER BY score DESC, index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mass FROM p),
    kept AS (SELECT * FROM c WHERE round(mass, 12) < {p})"""


@query(f"WITH {_V}, {_LONG}, {_TOP_P.format(of='l', p=0.4)} SELECT vec_id, index, round(probability, 9) AS probability FROM kept")
def top_p_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensors.top_p(_long(spark, sf_dir), "vec_id", "index", "score", 0.4).select("vec_id", "index", r9("probability"))


@query(f"""
    WITH {_V}, {_LONG}, scaled AS (SELECT vec_id, index, score / 0.7 AS score FROM l), topk AS (SELECT vec_id, index, score FROM (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY score DESC) AS k FROM scaled) WHERE k <= 20),
         {_TOP_P.format(of='topk', p=0.8)}, sh AS (SELECT *, probability / sum(probability) OVER (PARTITION BY vec_id) AS share FROM kept),
         up AS (SELECT *, sum(share) OVER (PARTITION BY vec_id ORDER BY score DESC, index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, {_U.format(key="'draw' || vec_id")} AS u FROM sh)
    SELECT vec_id, arg_max(index, score) AS greedy, coalesce(arg_min(index, upto) FILTER (WHERE round(upto, 12) > u), arg_max(index, upto)) AS drawn, count(*) AS candidates FROM up GROUP BY vec_id""")
def sampling_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.conv(F.substring(F.sha2(F.concat(F.lit("draw"), F.col("vec_id").cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    return tensors.sampled(_long(spark, sf_dir), "vec_id", "index", "score", u, 0.7, 20, 0.8)


@query("""
    WITH i AS (SELECT vec_id, list_transform(embedding, lambda x: floor(abs(x::DOUBLE) * 40)::INTEGER) AS ids FROM embeddings)
    SELECT vec_id, CASE WHEN list_position(ids, 2) > 0 THEN list_position(ids, 2) ELSE len(ids) END::INTEGER AS length, sha256(array_to_string(CASE WHEN list_position(ids, 2) > 0 THEN ids[: list_position(ids, 2)] ELSE ids END, ',')) AS ids FROM i""")
def eos_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(F.abs(x) * 40).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", tensors.until_end(ids, 2).alias("ids"))
    return rows.select("vec_id", F.size("ids").alias("length"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: floor(abs(x::DOUBLE) * 40)::INTEGER NOT IN (0, 1) AND x > 0))::INTEGER AS eligible FROM embeddings")
def eligible_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions that are attended (positive components here) and neither padding nor the first mark."""
    x = F.col("embedding").cast("array<double>")
    mask = tensors.eligible(F.transform(x, lambda v: F.floor(F.abs(v) * 40).cast("int")), F.transform(x, lambda v: v > 0))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(F.filter(mask, lambda m: m)).alias("eligible"))


@query(f"""
    WITH RECURSIVE {_V}, st AS (SELECT vec_id, 0 AS i, 0.0::DOUBLE AS state, 0.0::DOUBLE AS out, x FROM v
        UNION ALL SELECT vec_id, i + 1, exp(-abs(x[i + 1])) * state + x[i + 2] * x[i + 3], x[i + 4] * (exp(-abs(x[i + 1])) * state + x[i + 2] * x[i + 3]), x FROM st WHERE i < 16)
    SELECT vec_id, round(max(state) FILTER (WHERE i = 16), 9) AS state, round(sum(out), 9) AS total FROM st GROUP BY vec_id""")
def ssd_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen steps; decay, input and output factors are neighbouring components."""
    x = _scaled()
    steps = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct((-F.abs(F.get(x, i))).alias("log_decay"), F.get(x, i + 1).alias("b"), F.get(x, i + 2).alias("x"), F.get(x, i + 3).alias("c")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", tensors.scan(steps).alias("s"))
    return rows.select("vec_id", r9(F.col("s.state"), "state"), r9(tensors.total(F.col("s.out")), "total"))


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda a: a::DOUBLE) AS x FROM embeddings), n AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda a: a * a)) / len(x) + 1e-6) AS s FROM v) SELECT vec_id, (unnest(range(1, 65)) - 1)::INTEGER AS index, round(unnest(list_transform(x, lambda a: a / s)), 9) AS value FROM n")
def rms_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(tensors.rms_norm(F.col("embedding").cast("array<double>"))).alias("index", "value"))
    return rows.select("vec_id", "index", r9("value"))


@query("""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda a: a::DOUBLE) AS x, (vec_id % 128)::DOUBLE AS p FROM embeddings), k AS (SELECT *, unnest(range(0, 64)) AS i FROM v),
         a AS (SELECT *, p * pow(10000.0::DOUBLE, -2.0::DOUBLE * (i % 32) / 64) AS t FROM k)
    SELECT vec_id, i::INTEGER AS index, round(CASE WHEN i < 32 THEN x[i + 1] * cos(t) - x[i + 33] * sin(t) ELSE x[i + 1] * cos(t) + x[i - 31] * sin(t) END, 9) AS value FROM a""")
def rope(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = tensors.rotated(F.col("embedding").cast("array<double>"), (F.col("vec_id") % 128).cast("double"), 64)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(turned).alias("index", "value")).select("vec_id", "index", r9("value"))


@query("""
    SELECT step, round(CASE WHEN step < 100 THEN (step + 1) / 100.0::DOUBLE ELSE 0.1::DOUBLE + 0.9::DOUBLE * 0.5 * (1 + cos(pi() * least(1.0::DOUBLE, (step - 100) / 1899.0::DOUBLE))) END, 9) AS multiplier FROM range(0, 2100) t(step)""")
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(2100).select(F.col("id").alias("step"), r9(schedules.lr_multiplier(F.col("id"), 2000, 0.05, 0.1), "multiplier"))


@query("""
    WITH g AS (SELECT schedule, length, step FROM (VALUES ('linear'), ('cosine')) a(schedule), (VALUES (16), (33), (128)) b(length), range(1, 17) c(step)),
         f AS (SELECT *, CASE schedule WHEN 'linear' THEN step / 16.0::DOUBLE ELSE 1 - cos(pi() * (step / 16.0::DOUBLE) / 2) END AS share FROM g)
    SELECT schedule, length, step::INTEGER AS step, CASE WHEN step = 16 THEN length ELSE least(length, greatest(1, ceil(length * share))) END::BIGINT AS open FROM f""")
def reveal_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.createDataFrame([(s, n, k) for s in ("linear", "cosine") for n in (16, 33, 128) for k in range(1, 17)], "schedule string, length int, step int")
    return grid.withColumn("open", schedules.reveals(F.col("step"), F.lit(16), F.col("length"), F.col("schedule")))


_CONFIGS = """
    cfg AS (SELECT * FROM (VALUES ('dense', 256::BIGINT, 6::BIGINT), ('dense', 320, 8), ('dense', 384, 10)) t(family, hidden, layers)),
    dense AS (SELECT hidden, layers, 16000 * hidden AS emb, layers * (2 * hidden * hidden + 2 * hidden * (hidden // 2)) AS att, layers * 3 * hidden * (hidden * 3) AS mlp, layers * (3 * hidden + hidden // 2) + hidden AS norms FROM cfg),
    ssm AS (SELECT hidden, layers, 16000 * hidden AS emb, 2 * hidden AS inn, layers * hidden * (4 * hidden + 2 * 64 + 8) AS ip, layers * 2 * hidden * hidden AS op, layers * (2 * hidden + 128) AS ch FROM cfg),
    acc AS (SELECT 'dense' AS family, hidden, layers, 2 * emb + att + mlp + norms AS parameters, 2 * (att + mlp + emb) + 4 * layers * 1024 * hidden AS forward_flops FROM dense
            UNION ALL SELECT 'state_space', hidden, layers, 2 * emb + ip + op + ch * 5 + layers * 24 + layers * 3 * hidden + hidden, 2 * (ip + op + emb) + 2 * ch * 4 + 6 * layers * inn * 64 FROM ssm
            UNION ALL SELECT 'bidirectional', hidden, layers, 2 * 16000 * hidden + layers * 4 * hidden * hidden + layers * 9 * hidden * hidden + (2 * layers + 1) * hidden, 2 * (layers * 13 * hidden * hidden + 16000 * hidden) + 4 * layers * 1024 * hidden FROM cfg)"""


def _accounting(spark: SparkSession) -> DataFrame:
    cfg = spark.createDataFrame([(256, 6), (320, 8), (384, 10)], "hidden long, layers long").withColumn("vocab", F.lit(16_000).cast("long"))
    h = F.col("hidden")
    dense = schedules.dense_accounting(cfg.withColumns({"kv": F.floor(h / 2), "mlp": 3 * h}), 1024)
    ssm = schedules.state_space_accounting(cfg.withColumns({"inner": 2 * h, "groups": F.lit(1).cast("long"), "state": F.lit(64).cast("long"), "heads": F.lit(8).cast("long"), "kernel": F.lit(4).cast("long"), "bias": F.lit(1).cast("long")}))
    both = schedules.bidirectional_accounting(cfg.withColumn("mlp", 3 * h), 1024)
    out = [d.select(F.lit(n).alias("family"), "hidden", "layers", "parameters", "forward_flops") for n, d in (("dense", dense), ("state_space", ssm), ("bidirectional", both))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"WITH {_CONFIGS} SELECT * FROM acc")
def model_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accounting(spark)


@query(f"""
    WITH {_CONFIGS}, d AS (SELECT hidden, forward_flops AS reference_flops FROM acc WHERE family = 'dense'), b AS (SELECT *, 3::HUGEINT * reference_flops * 100000000 AS total FROM acc JOIN d USING (hidden)),
         s AS (SELECT *, ((total + 3 * forward_flops - 1) // (3 * forward_flops) + 8191) // 8192 AS steps FROM b)
    SELECT family, hidden, steps::BIGINT AS steps, (steps * 8192)::BIGINT AS tokens, round((3 * forward_flops)::DOUBLE * (steps * 8192) / total::DOUBLE, 9) AS flop_ratio, (3 * forward_flops)::DOUBLE * (steps * 8192) / total::DOUBLE BETWEEN 0.97 AND 1.03 AS within_window FROM s""")
def flop_matched_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = _accounting(spark)
    reference = acc.filter("family = 'dense'").select("hidden", F.col("forward_flops").alias("reference_flops"))
    rows = acc.join(reference, "hidden").withColumn("reference_tokens", F.lit(100_000_000).cast("long"))
    return schedules.matched_budget(rows, "reference_flops", "forward_flops", "reference_tokens", 8192).select("family", "hidden", "steps", "tokens", r9("flop_ratio"), "within_window")


@query(f"WITH {_CONFIGS} SELECT family, hidden, (3::HUGEINT * forward_flops * 500000000)::DOUBLE AS training_flops, 12 * parameters AS checkpoint_bytes, 48 * parameters AS retained_bytes, round(500000000 / 400000.0, 9) AS seconds FROM acc")
def run_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _accounting(spark).withColumns({"tokens": F.lit(500_000_000).cast("long"), "rate": F.lit(400_000.0)})
    return schedules.run_plan(rows, 3).select("family", "hidden", "training_flops", "checkpoint_bytes", "retained_bytes", r9("seconds"))


@query("SELECT o_orderkey, 'step-' || lpad(o_orderkey::VARCHAR, 12, '0') AS checkpoint_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS step FROM orders")
def step_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and the steps read back from them; every third one is spoilt."""
    name = labels.step_id(F.col("o_orderkey"))
    spoilt = F.when(F.col("o_orderkey") % 3 == 0, F.concat(name, F.lit("x"))).otherwise(name)
    return table(spark, sf_dir, "orders").select("o_orderkey", name.alias("checkpoint_id"), labels.step_of(spoilt).alias("step"))


@query("SELECT p_partkey, replace(replace(p_type, ' ', '_'), '_', '-') AS slug, CASE WHEN lower(p_name) LIKE '%flash%' THEN 'flash' WHEN lower(p_name) LIKE '%efficient%' THEN 'efficient' WHEN lower(p_name) LIKE '%cudnn%' THEN 'cudnn' WHEN lower(p_name) LIKE '%math%' THEN 'math' ELSE 'other' END AS family, CASE WHEN p_size > 0 THEN round(p_retailprice / (p_size * 8), 9) END AS utilisation FROM part")
def names_and_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", labels.slug(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("slug"), labels.kernel_family(F.col("p_name")).alias("family"), r9(labels.utilisation(F.col("p_retailprice"), F.col("p_size"), F.lit(8)), "utilisation"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 1e6 THEN printf('%.1fM', o_totalprice / 1e6) WHEN o_totalprice >= 1e3 THEN printf('%.1fK', o_totalprice / 1e3) ELSE printf('%.2f', o_totalprice) END AS shown FROM orders")
def compact_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.ship import ship

    ship(spark)
    return table(spark, sf_dir, "orders").select("o_orderkey", labels.compact(F.col("o_totalprice")).alias("shown"))
