"""Plans of training runs and reports that bind the records of finished ones together. Their inputs are a few small files."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import schedules
from lodestone.functions.canonical import canonical, digest
from lodestone.operators import reports
from lodestone.sources import files, records

#: The seeds and the families of a study, and the architecture that a checkpoint of each family names.
SEEDS, FAMILIES = (1337, 2027, 3407), ("dense", "state_space", "bidirectional")
ARCHITECTURES = {"dense": "olmo2", "state_space": "mamba2", "bidirectional": "masked_diffusion"}
#: The variants of the dense model (name, change, model variant, optimizer variant) and their screen.
VARIANTS = (
    ("baseline", "none", "baseline", "adamw"),
    ("learned_absolute_positions", "rope_to_learned_absolute_positions", "learned_absolute_positions", "adamw"),
    ("layer_norm", "rmsnorm_to_layernorm", "layer_norm", "adamw"),
    ("gelu", "swiglu_to_gelu", "gelu", "adamw"),
    ("mha", "gqa_to_mha", "mha", "adamw"),
    ("without_qk_norm", "remove_qk_normalization", "without_qk_norm", "adamw"),
    ("tied_embeddings", "tie_input_output_embeddings", "tied_embeddings", "adamw"),
    ("hybrid_muon", "adamw_to_hybrid_muon", "baseline", "hybrid_muon"),
)
SCREEN_TOKENS, SCREEN_LENGTH = 100_000_000, 1024
#: What the downstream records of a variant must have been made with.
EVALUATED = {"split": "validation", "batch_count": 24, "sequence_count": 192, "predicted_token_count": 196_416}
GENERATED = {"generated_token_count": 16, "model_forwards": 16}


def demand(holds: bool, otherwise: str) -> None:
    if not holds:
        raise ValueError(otherwise)


def one_value(values: list, otherwise: str) -> object:
    """The value that all have."""
    demand(len({canonical(v) for v in values}) == 1, otherwise)
    return values[0]


def model_summary(spark: SparkSession, family: str, config: str, sequence: int = 1024) -> dict:
    """Parameters and forward FLOPs of a configuration, a JSON object of whole numbers."""
    df = spark.createDataFrame([json.loads(config)])
    out = {"dense": lambda: schedules.dense_accounting(df, sequence), "state_space": lambda: schedules.state_space_accounting(df), "bidirectional": lambda: schedules.bidirectional_accounting(df, sequence)}[family]()
    return out.first().asDict()


def pretrain_plan(spark: SparkSession, family: str, config: str, target_tokens: int = 500_000_000, sequence: int = 1024, micro_batch: int = 8, accumulation: int = 1, world: int = 1, keep: int = 3, tokens_per_second: float = 0.0) -> dict:
    """What a run would take, without running it: steps, tokens, FLOPs, checkpoint bytes and, from a rate, seconds."""
    own = model_summary(spark, family, config, sequence)
    local = sequence * micro_batch * accumulation
    steps = -(-target_tokens // (local * world))
    total = steps * local * world
    out = {"family": family, "model_config_sha256": digest(json.loads(config)), "parameters": own["parameters"], "optimizer_steps": steps, "micro_batches_per_step": accumulation, "world_size": world, "local_tokens_per_step": local, "tokens_per_step": local * world, "training_tokens": total}
    return out | {"training_flops": 3 * own["forward_flops"] * total, "checkpoint_bytes": 12 * own["parameters"], "retained_bytes": 12 * own["parameters"] * (keep + 1), "seconds": total / tokens_per_second if tokens_per_second else None}


def plan_ablations(spark: SparkSession, study: str, artifacts: str = "artifacts/dense-ablations") -> dict:
    """A job for each variant of the dense model and each seed, under the budget of the study's first screen.

    The baseline's jobs reuse the study's own runs where their checkpoints are there. study: a JSON object.
    """
    body = files.read(study)
    source = json.loads(body)
    dense = {x["seed"]: x for x in source["lineages"] if x["architecture"] == "dense"}
    demand(len(dense) == len(SEEDS) and set(dense) == set(SEEDS), "the study must hold one dense lineage for each of the three seeds")
    demand(source["sequence_length"] == SCREEN_LENGTH and source["micro_batch_size"] > 0, f"the study must have batches of {SCREEN_LENGTH} tokens")
    demand(source["screening_dense_reference_tokens"] == SCREEN_TOKENS, f"the study's screen must have {SCREEN_TOKENS} tokens")
    boundary = one_value([x["screening"] for x in dense.values()], "the dense lineages end their screens at different steps")
    jobs = []
    for name, change, model, optimizer in VARIANTS:
        spec = digest({"name": name, "change": change, "model_variant": model, "optimizer_variant": optimizer})
        for seed in SEEDS:
            own, top = dense[seed], f"{artifacts}/{name}/seed-{seed}"
            reused = name == "baseline" and files.exists(own["screening_checkpoint"])
            status = "ready_for_bounded_smoke" if name != "baseline" else "reuse_screening" if reused else "requires_checkpoint_recovery"
            job = {"variant": name, "variant_spec_sha256": spec, "seed": seed, "execution_status": status, "model_variant": model, "optimizer_variant": optimizer}
            job |= {"artifact_directory": top, "checkpoint_directory": f"{top}/checkpoints", "jsonl_log": f"{top}/events.jsonl", "expected_optimizer_step": boundary["optimizer_step"], "expected_tokens": boundary["tokens_consumed"]}
            jobs.append(job | {c: own[c] if reused else None for c in ("model_config_sha256", "training_config_sha256", "screening_checkpoint")})
    kept = {c: source[c] for c in ("shard_manifest_sha256", "tokenizer_sha256", "sequence_length", "micro_batch_size", "gradient_accumulation_steps")}
    return kept | {"study_sha256": digest(source), "dense_reference_tokens": SCREEN_TOKENS, "seeds": list(SEEDS), "variants": [v[0] for v in VARIANTS], "jobs": jobs}


def inspect_cell(spark: SparkSession, plan: str, architecture: str, cell: str) -> dict:
    """The one planned cell of an architecture. plan: a JSON object with `cells`, or JSON lines."""
    body = files.read(plan).decode()
    cells = json.loads(body)["cells"] if body.lstrip().startswith('{"cells"') else [json.loads(x) for x in body.splitlines() if x.strip()]
    found = [c for c in cells if c["architecture"] == architecture and c["cell"] == cell]
    demand(len(found) == 1, f"{architecture}, {cell} is planned {len(found)} times, not once")
    return found[0]


def ablation_downstream_report(spark: SparkSession, report: str, evaluations: str, generations: str, seed: int = 2027) -> list[dict]:
    """The recommended variants' jobs of one seed, each with the one evaluation and the one generation made from it.

    report: a JSON object with `recommended_variants` and `jobs`; evaluations and generations: folders with a file of one
    canonical record for each variant, whose name holds <variant>-<seed> with "-" for "_".
    """

    def only(folder: str, name: str) -> dict:
        found = [f for f, _ in files.listing(folder) if re.search(rf"(?<![a-z]){name}(?![0-9]).*\.jsonl$", f)]
        demand(len(found) == 1, f"{folder} has {len(found)} records of {name}, not one")
        return records.single_record(f"{folder}/{found[0]}")

    source = json.loads(files.read(report))
    demand(not source.get("source_dirty"), "the report was made from a changed source")
    out = []
    for variant in source["recommended_variants"]:
        jobs = [j for j in source["jobs"] if j["variant"] == variant and j["seed"] == seed]
        demand(len(jobs) == 1, f"the report has {len(jobs)} jobs of {variant} and seed {seed}, not one")
        job, name = jobs[0], f"{variant.replace('_', '-')}-{seed}"
        e, g = only(evaluations, name), only(generations, name)
        binds = all(e.get(k) == v for k, v in EVALUATED.items()) and all(g.get("result", g).get(k) == v for k, v in GENERATED.items())
        binds = binds and all(e.get(c) == job[c] for c in ("model_config_sha256", "shard_manifest_sha256", "tokenizer_sha256")) and all(g.get(c) == job[c] for c in ("model_config_sha256", "tokenizer_sha256"))
        demand(binds, f"what was measured doesn't bind to {variant} and seed {seed}")
        out.append({"variant": variant, "seed": seed, "job": job, "evaluation": e, "generation": g})
    return out


def training_evidence(spark: SparkSession, log: str) -> tuple[str, list[dict]]:
    """The hash of a run's configuration and its steps, from a log with one start, one resume and steps 1 to n."""
    rows = records.canonical_events(spark, log)
    marks = [json.loads(r["value"]) for r in rows.filter(F.col("event").isin("run_start", "run_resume")).orderBy("line").limit(5).collect()]
    starts, resumes = ([m for m in marks if m["event"] == e] for e in ("run_start", "run_resume"))
    demand(len(starts) == len(resumes) == 1, "the log must have one start and one resume")
    config_hash = starts[0].get("training_config_sha256")
    demand(isinstance(config_hash, str) and config_hash == resumes[0].get("training_config_sha256"), "the configuration changed across the resume")
    config = starts[0].get("training_config")
    demand(isinstance(config, dict), "the configuration isn't there")
    demand(config.get("device") == "cuda" and config.get("precision") == "bf16" and config.get("compile_model") is True, "the run wasn't compiled bf16 training on an accelerator")
    steps = [json.loads(r["value"]) for r in rows.filter("event = 'optimizer_step'").orderBy("line").collect()]  # a smoke run has some tens
    demand([s.get("optimizer_step") for s in steps] == list(range(1, len(steps) + 1)), "the steps are not contiguous")
    return config_hash, steps


def smoke_report(spark: SparkSession, family: str, training: str, checkpoint: str, evaluation: str, export: str, generation: str) -> dict:
    """One record of a smoke run, after its log, checkpoint, evaluation, export and generation have been found to agree."""
    config_hash, steps = training_evidence(spark, training)
    point, e, x, g = json.loads(files.read(checkpoint)), records.single_record(evaluation), json.loads(files.read(export)), records.single_record(generation)
    demand(canonical(point).encode() == files.read(checkpoint).rstrip(b"\n"), "the checkpoint's manifest is not canonical")
    binding, own_hash = point["binding"], digest(point)
    demand(binding["architecture"] == ARCHITECTURES[family], "the checkpoint has another architecture")
    demand(not binding["git"]["dirty"], "the checkpoint was made from a changed source")
    demand(bool(steps) and steps[-1]["optimizer_step"] == point["progress"]["optimizer_step"], "the steps don't reach the checkpoint")
    demand(steps[-1]["tokens_consumed"] == point["progress"]["tokens_consumed"], "the steps' tokens aren't the checkpoint's")
    demand(point["lineage"]["parent_checkpoint_id"] is not None, "the checkpoint has no parent, so nothing was resumed")
    for field, what in (("model_config_sha256", "model configuration"), ("tokenizer_sha256", "tokenizer")):
        one_value([binding[field], e[field], x[field], g[field]], f"the {what} hashes disagree")
    demand(e["shard_manifest_sha256"] == binding["shard_manifest_sha256"], "the evaluation used other shards")
    bound = [("export", x)] + ([("evaluation", e), ("generation", g)] if family == "bidirectional" else [])
    for what, record in bound:
        demand(record["source_checkpoint_id"] == point["lineage"]["checkpoint_id"], f"the {what} names another checkpoint")
        demand(record["source_checkpoint_manifest_sha256"] == own_hash, f"the {what} names another checkpoint manifest")
    runtime = binding["runtime"]
    demand(runtime["cuda_available"] and runtime["cuda_version"] is not None, "the checkpoint tells of no accelerator")
    at = max(point["created_at_utc"], e["evaluated_at_utc"], g["generated_at_utc"])
    kept = {c: binding[c] for c in ("architecture", "model_config_sha256", "shard_manifest_sha256", "tokenizer_sha256")}
    kept |= {"recorded_at_utc": at, "source_git_revision": binding["git"]["revision"], "training_config_sha256": config_hash, "checkpoint_id": point["lineage"]["checkpoint_id"], "checkpoint_manifest_sha256": own_hash, "parent_checkpoint_id": point["lineage"]["parent_checkpoint_id"]}
    return kept | {"final_tokens_consumed": point["progress"]["tokens_consumed"], "training_steps": steps, "evaluation": e, "export": x, "generation": g}


def evaluation_rollup(spark: SparkSession, kind: str, rows: str) -> list[dict]:
    """Batch records (Parquet) summed up by run: causal (run, loss, tokens), diffusion (run, weighted_loss, token_loss, masked,
    correct, examples) or preference (role, chosen, rejected, chosen_tokens, rejected_tokens, truncated)."""
    df: DataFrame = spark.read.parquet(rows)
    out = {"causal": lambda: reports.perplexity(df, "run", "loss", "tokens"), "diffusion": lambda: reports.diffusion_rollup(df, "run"), "preference": lambda: reports.preference_summary(df, "role")}[kind]()
    return [r.asDict() for r in out.orderBy(out.columns[0]).collect()]  # a row a run
