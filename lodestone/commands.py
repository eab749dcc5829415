"""The data commands: sample, tokenizer, shards, mixes, plans and reports, as functions and as `python -m lodestone COMMAND`."""

from __future__ import annotations

import argparse
import inspect
import json
import time
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import schedules
from lodestone.functions.canonical import canonical, digest
from lodestone.operators import chat, metrics, reports, selection, shards, text, tokenizer
from lodestone.session import saved, session
from lodestone.sources import files, records, sinks
from lodestone.study import SEEDS, ablation_downstream_report, evaluation_rollup, inspect_cell, model_summary, plan_ablations, pretrain_plan, smoke_report

#: The fields of a step in a run's log; those in OPTIONAL may be missing or null.
STEP = "event string, recorded_at_utc timestamp, optimizer_step long, measurement_optimizer_steps long, loss double, learning_rate double, gradient_norm double, tokens_consumed long, elapsed_seconds double, tokens_per_second double, peak_cuda_memory_allocated_bytes long, peak_cuda_memory_reserved_bytes long"
OPTIONAL = ("measurement_optimizer_steps", "peak_cuda_memory_allocated_bytes", "peak_cuda_memory_reserved_bytes")


def sample(spark: SparkSession, source: str, output: str, target_bytes: int = 100_000_000, order: str = "doc_id", column: str = "text") -> dict:
    """The first distinct non-empty texts, until their bytes reach the target, with hashes and a manifest. A source that ends before is an error."""
    docs = spark.read.parquet(source)
    found = text.budget_accounting(docs, column, order, target_bytes).first().asDict()
    if found["kept_bytes"] < target_bytes:
        raise ValueError(f"the source ended after {found['kept_bytes']} of {target_bytes} bytes")
    kept = text.budget_prefix(docs, column, order, target_bytes)
    made = sinks.write_sample(docs.join(kept.select(order), order, "left_semi"), output, order, column)
    return {k: v for k, v in made.items() if k != "files"} | found


def verify_sample(spark: SparkSession, path: str) -> dict:
    return {"status": "valid", "documents": records.checked_sample(spark, path).count()}


def train_tokenizer(spark: SparkSession, sample_path: str, output: str, vocabulary: int = 16_000, least: int = 2, mode: str = "gpt2", resume: str = "", checkpoint_every: int = 1000, pause_after: int = 0) -> dict:
    """A tokenizer file: merges, mode and a hash over both. resume: a file whose merges are replayed first.

    Every checkpoint_every merges what is there is written beside it, as <output>.checkpoint, which resume takes;
    pause_after: as many new merges at most.
    """
    first = load_tokenizer(resume).merges if resume else ()
    body = lambda merges: {"format": "lodestone-byte-pairs", "version": 1, "mode": mode, "merges": [list(m) for m in merges]}
    signed = lambda merges: (own := body(merges)) | {"sha256": digest(own)}

    def on_merge(merges: tuple, _: int) -> None:
        if len(merges) % checkpoint_every == 0:
            sinks.write_json(f"{output}.checkpoint", signed(merges), replace=True)

    pairs = tokenizer.train(records.checked_sample(spark, sample_path), "text", vocabulary, least, mode, first, on_merge=on_merge, pause_after=pause_after or None)
    sinks.write_json(output, signed(pairs.merges))
    return {"merges": len(pairs.merges), "sha256": digest(body(pairs.merges))}


def load_tokenizer(path: str) -> tokenizer.BytePairs:
    body = records.closed(json.loads(files.read(path)), path, format=str, version=int, mode=str, merges=list, sha256=str)
    if digest({k: v for k, v in body.items() if k != "sha256"}) != body.get("sha256"):
        raise ValueError(f"{path} isn't what its hash says")
    return tokenizer.BytePairs(tuple(tuple(m) for m in body["merges"]), body["mode"])


def benchmark_tokenizer(spark: SparkSession, sample_path: str, tokenizer_path: str) -> dict:
    """Documents, bytes, tokens and rates of encoding a whole sample, after one run to warm up."""
    pairs = load_tokenizer(tokenizer_path)
    rows = records.checked_sample(spark, sample_path).select(F.octet_length("text").alias("bytes"), F.size(tokenizer.encoded(spark, pairs, F.col("text"))).alias("tokens"))
    run = lambda: rows.agg(F.count("*").alias("documents"), F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens")).first().asDict()
    run()
    began = time.perf_counter()
    total = run()
    seconds = time.perf_counter() - began
    return total | {"seconds": seconds, "tokens_per_second": total["tokens"] / seconds}


def verify_tokenizer_oracle(spark: SparkSession, tokenizer_path: str, sample_path: str, least: int = 2) -> dict:
    """Trains again and encodes every document by the plain definitions, which count everything anew for each merge; any difference is an error."""
    pairs, docs = load_tokenizer(tokenizer_path), records.checked_sample(spark, sample_path)
    merges = tokenizer.plain_merges(tokenizer.segment_frequencies(docs, "text", pairs.mode), len(pairs.merges), least)
    if merges != list(pairs.merges):
        at = next((k for k, (a, b) in enumerate(zip(merges, pairs.merges, strict=False)) if a != b), min(len(merges), len(pairs.merges)))
        raise ValueError(f"merge {at} differs from the plain trainer's")
    differs = docs.select(tokenizer.encoded(spark, pairs, F.col("text")).alias("fast"), tokenizer.plainly_encoded(spark, pairs, F.col("text")).alias("plain"))
    found = differs.agg(F.count("*").alias("documents"), F.sum(F.size("fast")).alias("tokens"), F.count_if(F.col("fast") != F.col("plain")).alias("differing")).first().asDict()
    if found.pop("differing"):
        raise ValueError("a document is encoded otherwise by the plain encoder")
    return found | {"merges": len(merges), "exact_parity": True}


def build_shards(spark: SparkSession, sample_path: str, tokenizer_path: str, output: str, cap: int = 100_000_000, seed: int = 1337, buckets: int = 10_000, validation: int = 100, test: int = 100) -> dict:
    """Hash split, encoding of whole texts, next-fit packing in source order, 16-bit shards."""
    pairs = load_tokenizer(tokenizer_path)
    split = text.hash_split(records.checked_sample(spark, sample_path), "text", text.SplitPolicy(seed, buckets, validation, test))
    again = split.groupBy("content_hash").agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect()
    if again:
        raise ValueError(f"{again[0]['content_hash']} is there {again[0]['n']} times")
    ids = saved(split.select("split", "ordinal", "content_hash", F.array_append(tokenizer.encoded(spark, pairs, F.col("text"), whole=True), shards.EOS).alias("ids")), "ids")
    packed = shards.next_fit(ids.select("split", "ordinal", F.size("ids").alias("tokens")), "split", "ordinal", "tokens", cap)
    rows = ids.join(packed.select("split", "ordinal", "shard", "start"), ["split", "ordinal"])
    return sinks.write_shards(rows, output, tokenizer.MERGES_FROM + len(pairs.merges), document="content_hash", tokenizer=json.loads(files.read(tokenizer_path))["sha256"])


def verify_shards(spark: SparkSession, path: str, tokenizer_path: str = "") -> dict:
    """A whole build against its manifest: files, tokenizer (that of a file, if given), totals, every shard, every document once."""
    expected = json.loads(files.read(tokenizer_path))["sha256"] if tokenizer_path else None
    listed = records.checked_shards(spark, path, expected)["shards"]
    return {"shards": len(listed), "tokens": sum(s["tokens"] for s in listed)}


def verify_shard(spark: SparkSession, path: str, file: str) -> dict:
    """One shard of a build: its length, hash and ids. The others aren't read."""
    own = [s for s in records.build_manifest(path)["shards"] if s["file"] == file]
    if len(own) != 1:
        raise ValueError(f"{file} is listed {len(own)} times in the manifest of {path}")
    found = records.token_shards(spark, path, only=file).agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("n")).first()["n"]
    if found != own[0]["tokens"]:
        raise ValueError(f"{file} has {found} tokens, not {own[0]['tokens']}")
    return own[0]


def prepare_sft_mix(spark: SparkSession, source: str, output: str, target: int, weights: str = "{}") -> dict:
    """Quotas by largest remainder over sources (table: source, idx, messages), first valid rows of each."""
    rows, own = spark.read.parquet(source), json.loads(weights)
    weight = reduce(lambda c, kv: c.when(F.col("source") == kv[0], float(kv[1])), own.items(), F.when(F.lit(False), 1.0)).otherwise(1.0)
    sources = rows.groupBy("source").agg(F.count("*").alias("available_examples")).withColumn("weight", weight)
    quotas = selection.largest_remainder(sources, target, "source")
    chosen = selection.first_valid(rows, quotas, "source", "idx", chat.is_supervised(F.col("messages")))
    sinks.write_records(chosen.drop("rank", "quota"), output, "idx")
    return {r["source"]: r["quota"] for r in quotas.collect()}


_PREFERENCE = dict(chosen="chosen", rejected="rejected", chosen_score="score_chosen", rejected_score="score_rejected", prompt_id="prompt_id")


def _valid_pairs(rows: DataFrame) -> DataFrame:
    return rows.filter(chat.is_preference(**{k: F.col(c) for k, c in _PREFERENCE.items()}))


def prepare_preference_mix(spark: SparkSession, source: str, output: str, pairs: int, seed: int = 1337) -> dict:
    """`pairs` valid pairs (table: idx, prompt_id, chosen, rejected, scores) by seeded digest."""
    rows = spark.read.parquet(source)
    chosen = sinks.write_records(selection.hash_topn(_valid_pairs(rows), pairs, seed, "prompt_id", "idx"), output, "idx")["records"]
    n, valid = rows.count(), _valid_pairs(rows).count()
    return {"source": n, "valid": valid, "rejected": n - valid, "selected": chosen}


def prepare_preference_holdout(spark: SparkSession, source: str, mix: str, output: str) -> dict:
    """All valid pairs that the mix hasn't taken."""
    valid = _valid_pairs(spark.read.parquet(source))
    taken = spark.read.schema("idx long, prompt_id string").json(f"{mix}/records")
    return {"selected": sinks.write_records(selection.holdout(valid, taken, "idx", "prompt_id"), output, "idx")["records"]}


def plan_study(spark: SparkSession, models: str, reference_tokens: int = 500_000_000, step_tokens: int = 8192) -> list[dict]:
    """Every family and seed with the budget that matches the dense model's FLOPs. models: JSON {family: forward FLOPs}."""
    flops = json.loads(models)
    rows = reports.plan_matrix(spark, family=list(flops), seed=list(SEEDS)).withColumn("forward_flops", reduce(lambda c, kv: c.when(F.col("family") == kv[0], kv[1]), flops.items(), F.when(F.lit(False), 0)).cast("long"))
    rows = rows.withColumns({"reference_flops": F.lit(flops["dense"]).cast("long"), "reference_tokens": F.lit(reference_tokens).cast("long")})
    return [r.asDict() for r in schedules.matched_budget(rows, "reference_flops", "forward_flops", "reference_tokens", step_tokens).orderBy("family", "seed").collect()]


def plan_calibration(spark: SparkSession, cells: str, repetitions: int = 3) -> list[dict]:
    return [r.asDict() for r in reports.plan_matrix(spark, cell=json.loads(cells), repetition=list(range(1, repetitions + 1))).orderBy("cell", "repetition").collect()]


def calibration_report(spark: SparkSession, results: str, plan: str = "", plan_sha256: str = "", speedup: float = 1.1, spread: float = 0.05, loss_tolerance: float = 0.01) -> list[dict]:
    """Gates over result files (architecture, cell, repetition, throughput, loss_delta, plan_sha256, baseline_trace_sha256,
    trace_sha256); a plan (JSON lines of the same key) must be met exactly, and a candidate's baseline must be of the same
    plan and have the numerical trace that the candidate was compared with."""
    rows = records.results(spark, results, "architecture string, cell string, repetition long, throughput double, loss_delta double, plan_sha256 string, trace_sha256 string, baseline_trace_sha256 string")
    if plan_sha256 and not rows.filter(~F.col("plan_sha256").eqNullSafe(F.lit(plan_sha256))).isEmpty():
        raise ValueError("a result is of another plan")
    key = ["architecture", "cell", "repetition"]
    if selection.repeated(rows, *key).limit(1).count():
        raise ValueError("a result is there twice")
    if plan:
        wrong = selection.completeness(records.json_lines(spark, plan, "architecture string, cell string, repetition long").select(*key), rows.select(*key)).limit(5).collect()
        if wrong:
            raise ValueError(f"plan and results differ: {[tuple(r) for r in wrong]}")
    compared = rows.withColumn("_trace", F.when(F.col("cell") == "baseline", F.col("trace_sha256")).otherwise(F.col("baseline_trace_sha256")))
    found = reports.with_baseline(compared, "baseline", "architecture", "repetition", bound=("plan_sha256", "_trace"))
    if not found.filter("missing_baseline").isEmpty():
        raise ValueError("a candidate has no baseline")
    if not found.filter("incompatible").isEmpty():
        raise ValueError("a candidate and its baseline are incompatible")
    return [r.asDict() for r in reports.calibration(rows, "baseline", speedup, spread, {"loss_delta": loss_tolerance}).orderBy("architecture", "cell").collect()]


def ablation_report(spark: SparkSession, results: str, best: int = 3) -> list[dict]:
    """Variants over three seeds each (variant, seed, loss, throughput), ranked; the finalists are the best and the fastest."""
    rows = records.results(spark, results, "variant string, seed long, loss double, throughput double")
    if rows.groupBy("variant").agg(F.countDistinct("seed").alias("n")).filter(F.col("n") != len(SEEDS)).limit(1).count():
        raise ValueError("a variant doesn't have three seeds")
    own = rows.groupBy(F.col("variant").alias("name")).agg(F.avg("loss").alias("loss"), reports.spread(F.col("loss")).alias("deviation"), F.avg("throughput").alias("throughput"))
    ranked = reports.ranked(own, "loss", "name", throughput="throughput")
    final = {r["name"] for r in selection.finalists(ranked, best).collect()}
    return [r.asDict() | {"finalist": r["name"] in final} for r in ranked.orderBy("position").collect()]


def materialize_metrics(spark: SparkSession, log: str, output: str) -> dict:
    """The last record of each step of a run's log, in the order of its lines, as a Parquet series of all its fields.

    Every line must be canonical JSON; a step must have the fields of STEP and no others, within their ranges. A log
    without steps, and an unfinished or finished series at `output`, are errors.
    """
    events = records.canonical_events(spark, log).filter("event = 'optimizer_step'")
    names = [c.split()[0] for c in STEP.split(", ")]
    required = F.array(*(F.lit(c) for c in names if c not in OPTIONAL))
    keys = F.json_object_keys("value")
    positive = lambda *cs: reduce(Column.__and__, (F.col(f"r.{c}") > 0 for c in cs))
    ok = (F.size(F.array_except(keys, F.array(*map(F.lit, names)))) == 0) & (F.size(F.array_except(required, keys)) == 0)
    ok = ok & positive("optimizer_step", "learning_rate", "tokens_consumed", "elapsed_seconds", "tokens_per_second") & (F.col("r.loss") >= 0) & (F.col("r.gradient_norm") >= 0) & F.col("r.recorded_at_utc").isNotNull()
    ok = ok & reduce(Column.__and__, (F.coalesce(F.col(f"r.{c}") > 0, F.get_json_object("value", f"$.{c}").isNull()) for c in OPTIONAL))
    rows = events.withColumn("r", F.from_json("value", STEP))
    wrong = F.raise_error(F.concat(F.lit("not a valid step: "), F.substring("value", 1, 80))).cast(rows.schema["r"].dataType)
    rows = rows.select("path", "line", F.when(F.coalesce(ok, F.lit(False)), F.col("r")).otherwise(wrong).alias("r")).select("path", "line", "r.*")
    rows = rows.withColumn("measurement_optimizer_steps", F.coalesce("measurement_optimizer_steps", F.lit(1).cast("long")))
    series = saved(metrics.latest(rows, ["optimizer_step"], ["path", "line"]).drop("path", "line"), "series")
    found = metrics.gaps(series.withColumn("run", F.lit(0)), "run", "optimizer_step").first()
    if found is None:
        raise ValueError("no optimizer step in the log")
    if files.exists(f"{output}.partial"):
        raise ValueError(f"an incomplete series is at {output}.partial")
    sinks.write_snapshot(series, output)
    return {"steps": found["steps"], "contiguous": found["contiguous"]}


def compare_runs(spark: SparkSession, expected: str, actual: str, absolute: float = 1e-5, relative: float = 1e-4) -> list[dict]:
    """Two tables (tensor, idx, value), aligned by key: errors and violations by tensor."""
    key = ["tensor", "idx"]
    found = reports.tolerance(spark.read.parquet(expected).select(*key, "value"), spark.read.parquet(actual).select(*key, "value"), key, "tensor", absolute, relative)
    return [r.asDict() | {"passed": not r["unmatched"] and not r["violations"]} for r in found.orderBy("tensor").collect()]


COMMANDS = {f.__name__.replace("_", "-"): f for f in (sample, verify_sample, train_tokenizer, benchmark_tokenizer, build_shards, verify_shards, verify_shard, verify_tokenizer_oracle, prepare_sft_mix, prepare_preference_mix, prepare_preference_holdout, model_summary, pretrain_plan, plan_study, plan_calibration, inspect_cell, calibration_report, plan_ablations, ablation_report, ablation_downstream_report, evaluation_rollup, smoke_report, materialize_metrics, compare_runs)}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lodestone")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, f in COMMANDS.items():
        own = commands.add_parser(name, help=inspect.getdoc(f))
        for p in list(inspect.signature(f).parameters.values())[1:]:
            kind = type(p.default) if p.default is not p.empty else int if p.annotation == "int" else str
            own.add_argument(f"--{p.name.replace('_', '-')}", dest=p.name, type=kind, required=p.default is p.empty, default=None if p.default is p.empty else p.default)
    given = vars(parser.parse_args(args))
    print(canonical(COMMANDS[given.pop("command")](session(), **given)))
