"""The data commands, one after another over small inputs."""

import hashlib
import json
import shutil

import pytest
from pyspark.sql import functions as F

from lodestone import commands as c
from lodestone.functions.canonical import canonical, digest
from lodestone.sources import records, sinks


def test_corpus_commands(spark, sf_dir, tmp_path):
    top = f"file://{tmp_path}"
    got = c.sample(spark, f"{sf_dir}/documents.parquet", f"{top}/sample", 100_000)
    assert got["kept"] == got["documents"] and got["kept_bytes"] >= 100_000 and got["scanned"] == got["kept"] + got["duplicates"] + got["empties"]
    assert c.verify_sample(spark, f"{top}/sample") == {"status": "valid", "documents": got["documents"]}
    with pytest.raises(ValueError, match="source ended"):
        c.sample(spark, f"{sf_dir}/documents.parquet", f"{top}/short", 10**12)
    assert not (tmp_path / "short").exists()
    made = c.train_tokenizer(spark, f"{top}/sample", f"{top}/t.json", 264 + 40, checkpoint_every=15)
    assert len(c.load_tokenizer(f"{top}/t.json.checkpoint").merges) == 30
    half = c.train_tokenizer(spark, f"{top}/sample", f"{top}/t3.json", 264 + 40, resume=f"{top}/t.json.checkpoint", pause_after=5)
    assert half["merges"] == 35 and c.load_tokenizer(f"{top}/t3.json").merges == c.load_tokenizer(f"{top}/t.json").merges[:35]
    again = c.train_tokenizer(spark, f"{top}/sample", f"{top}/t2.json", 264 + 50, resume=f"{top}/t.json")
    assert made["merges"] == 40 and again["merges"] == 50
    assert c.load_tokenizer(f"{top}/t2.json").merges[:40] == c.load_tokenizer(f"{top}/t.json").merges
    rates = c.benchmark_tokenizer(spark, f"{top}/sample", f"{top}/t.json")
    assert rates["documents"] == got["documents"] and rates["tokens"] < rates["bytes"]
    build = c.build_shards(spark, f"{top}/sample", f"{top}/t.json", f"{top}/shards", 60_000, 7, 10, 2, 2)
    assert build["vocabulary"] == 304 and sum(s["documents"] for s in build["shards"]) == got["documents"]
    assert c.verify_shards(spark, f"{top}/shards") == {"shards": len(build["shards"]), "tokens": sum(s["tokens"] for s in build["shards"])}
    first = build["shards"][0]
    assert c.verify_shard(spark, f"{top}/shards", first["file"]) == first and first["tokenizer"] == made["sha256"]
    assert c.verify_shards(spark, f"{top}/shards", f"{top}/t.json")["shards"] == len(build["shards"])
    with pytest.raises(ValueError, match="another tokenizer"):
        c.verify_shards(spark, f"{top}/shards", f"{top}/t2.json")
    with pytest.raises(FileExistsError):
        c.build_shards(spark, f"{top}/sample", f"{top}/t.json", f"{top}/shards", 60_000)
    with pytest.raises(Exception, match="larger than a shard"):
        c.build_shards(spark, f"{top}/sample", f"{top}/t.json", f"{top}/none", 1)
    assert not [x for x in tmp_path.iterdir() if x.name.startswith("none")]
    body = json.loads((tmp_path / "t.json").read_text())
    (tmp_path / "bad.json").write_text(json.dumps(body | {"mode": "none"}))
    with pytest.raises(ValueError):
        c.load_tokenizer(f"{top}/bad.json")


def spoilt(tmp_path, folder, name, change):
    """A copy of a folder with one file changed; gives its path."""
    to = tmp_path / f"{folder}-{len(list(tmp_path.iterdir()))}"
    shutil.copytree(tmp_path / folder, to, ignore=shutil.ignore_patterns(".*.crc"))
    change(to / name if name else to)
    return f"file://{to}"


def rewritten(change):
    def run(path):
        body = json.loads(path.read_text())
        change(body)
        path.write_text(json.dumps(body))

    return run


def test_samples_that_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(0, "naïve"), (1, "café"), (2, "text")], "doc_id long, text string")
    made = sinks.write_sample(df, f"file://{tmp_path}/sample", "doc_id", "text")
    assert [r["text"] for r in records.checked_sample(spark, f"file://{tmp_path}/sample").orderBy("ordinal").collect()] == ["naïve", "café", "text"]
    docs = next(f["file"] for f in made["files"] if f["file"].startswith("documents") and f["bytes"])
    hashes = next(f["file"] for f in made["files"] if f["file"].startswith("hashes") and f["bytes"])
    cases = [
        (docs, lambda p: p.write_text("corrupt\n"), "checksum mismatch"),
        (hashes, lambda p: p.write_bytes(p.read_bytes()[:-2]), "checksum mismatch"),
        (docs, lambda p: p.unlink(), "missing or not in its manifest"),
        ("documents", lambda p: (p / "extra.json").write_text("{}"), "missing or not in its manifest"),
        ("manifest.json", rewritten(lambda m: m.update(documents=4)), "isn't what its manifest says"),
        ("manifest.json", rewritten(lambda m: m.update(bytes=1)), "isn't what its manifest says"),
        ("manifest.json", rewritten(lambda m: m.update(content_sha256="0" * 64)), "digest over all documents"),
        ("manifest.json", rewritten(lambda m: m.update(more=1)), "has not the keys"),
        ("manifest.json", rewritten(lambda m: m.pop("bytes")), "has not the keys"),
        ("manifest.json", rewritten(lambda m: m.update(documents="3")), "documents is"),
    ]
    for name, change, message in cases:
        with pytest.raises(ValueError, match=message):
            records.checked_sample(spark, spoilt(tmp_path, "sample", name, change))
    with pytest.raises(FileExistsError):
        sinks.write_sample(df, f"file://{tmp_path}/sample", "doc_id", "text")


def test_shards_that_are_refused(spark, tmp_path):
    rows = [("train", k // 2, 3 * (k % 2), [8 + k, 9, 2], f"{k:064x}") for k in range(4)]
    df = spark.createDataFrame(rows, "split string, shard long, start long, ids array<int>, h string")
    build = sinks.write_shards(df, f"file://{tmp_path}/shards", 300, document="h", tokenizer="a" * 64)
    first = build["shards"][0]["file"]
    held = next(p for p in (tmp_path / "shards/documents").iterdir() if p.suffix == ".json" and p.stat().st_size)
    again = json.dumps({"split": "train", "shard": 1, "sha256": rows[0][4]}) + "\n"
    cases = [
        (first, lambda p: p.write_bytes(p.read_bytes()[:-2]), "truncated"),
        (first, lambda p: p.write_bytes(b"\x01\x00" + p.read_bytes()[2:]), "checksum"),
        ("", lambda p: (p / "train-00009.bin").write_bytes(b"\0\0"), "orphaned"),
        (first, lambda p: p.unlink(), "orphaned or missing"),
        ("", lambda p: (p / ".train-00000.bin.partial").write_bytes(b"\0\0"), "incomplete shard"),
        ("manifest.json", rewritten(lambda m: m["shards"][1].update(tokenizer="0" * 64)), "mixed tokenizers"),
        ("manifest.json", rewritten(lambda m: m["splits"]["train"].update(tokens=13)), "token count"),
        ("manifest.json", rewritten(lambda m: m.pop("splits")), "has not the keys"),
        ("manifest.json", rewritten(lambda m: m["shards"][0].pop("sha256")), "has not the keys"),
        ("manifest.json", rewritten(lambda m: m.update(vocabulary=9)), "outside the vocabulary"),
        (f"documents/{held.name}", lambda p: p.write_text(p.read_text() + again), "more than one shard"),
        (f"documents/{held.name}", lambda p: p.write_text(p.read_text().replace("0" * 63, "Z" * 63)), "malformed"),
        (f"documents/{held.name}", lambda p: p.write_text(p.read_text().split("\n", 1)[1]), "documents don't add up"),
    ]
    for name, change, message in cases:
        with pytest.raises(Exception, match=message):
            records.checked_shards(spark, spoilt(tmp_path, "shards", name, change))
    with pytest.raises(ValueError, match="another vocabulary"):
        records.checked_shards(spark, f"file://{tmp_path}/shards", vocabulary=301)
    with pytest.raises(ValueError, match="listed 0 times"):
        c.verify_shard(spark, f"file://{tmp_path}/shards", "train-00007.bin")


def test_tokenizer_oracle(spark, tmp_path):
    top = f"file://{tmp_path}"
    df = spark.createDataFrame(list(enumerate(["banana bandana", "ananas an", "naïve café", "aaa aaaa  a\n\n"] * 3)), "doc_id long, text string")
    sinks.write_sample(df.filter("doc_id < 12"), f"{top}/sample", "doc_id", "text")
    c.train_tokenizer(spark, f"{top}/sample", f"{top}/t.json", 264 + 12)
    assert c.verify_tokenizer_oracle(spark, f"{top}/t.json", f"{top}/sample")["exact_parity"]
    body = json.loads((tmp_path / "t.json").read_text())
    body["merges"][2:4] = body["merges"][3:1:-1]
    body["sha256"] = digest({k: v for k, v in body.items() if k != "sha256"})
    (tmp_path / "u.json").write_text(json.dumps(body))
    with pytest.raises(ValueError, match="merge 2 differs"):
        c.verify_tokenizer_oracle(spark, f"{top}/u.json", f"{top}/sample")


def step(n, **more):
    return {"event": "optimizer_step", "recorded_at_utc": f"2026-01-01T00:00:{n:02d}Z", "optimizer_step": n, "loss": 2.0, "learning_rate": 0.001, "gradient_norm": 1.0, "tokens_consumed": 8 * n, "elapsed_seconds": 0.5, "tokens_per_second": 16.0, "peak_cuda_memory_allocated_bytes": None, "peak_cuda_memory_reserved_bytes": 5} | more


def test_metric_logs(spark, tmp_path):
    path, out = tmp_path / "log.jsonl", tmp_path / "series"
    put = lambda *events: path.write_text("".join(canonical(e) + "\n" for e in events))
    put({"event": "run_start"}, step(1), step(2), step(1, loss=1.5), {"event": "other", "x": 1})
    assert c.materialize_metrics(spark, f"{path}", f"{out}") == {"steps": 2, "contiguous": True}
    got = spark.read.parquet(f"{out}").orderBy("optimizer_step").collect()
    assert [(r["optimizer_step"], r["loss"], r["measurement_optimizer_steps"], r["peak_cuda_memory_reserved_bytes"]) for r in got] == [(1, 1.5, 1, 5), (2, 2.0, 1, 5)]
    assert len(got[0]) == 12 and got[0]["recorded_at_utc"].second == 1
    with pytest.raises(FileExistsError):
        c.materialize_metrics(spark, f"{path}", f"{out}")
    none = f"{tmp_path}/none"
    for text, message in (('{"event": "run_start"}\n', "not canonical"), ("{broken\n", "invalid"), (canonical(step(1)) + "\n[1]\n", "not canonical"), (canonical({"event": "run_start"}) + "\n", "no optimizer step")):
        path.write_text(text)
        with pytest.raises(Exception, match=message):
            c.materialize_metrics(spark, f"{path}", none)
    for bad in (step(0), step(1, loss=-1.0), step(1, more=1), {k: v for k, v in step(1).items() if k != "loss"}, step(1, recorded_at_utc="soon"), step(1, peak_cuda_memory_reserved_bytes=0), step(1, tokens_per_second="x")):
        put(bad)
        with pytest.raises(Exception, match="not a valid step"):
            c.materialize_metrics(spark, f"{path}", none)
    put(step(1), step(3))
    (tmp_path / "none.partial").mkdir()
    with pytest.raises(ValueError, match="incomplete"):
        c.materialize_metrics(spark, f"{path}", none)
    (tmp_path / "none.partial").rmdir()
    assert c.materialize_metrics(spark, f"{path}", none) == {"steps": 2, "contiguous": False}


def test_event_log(tmp_path):
    now = [0.0]
    with sinks.EventLog(f"{tmp_path}/e.jsonl", every=3, seconds=10, clock=lambda: now[0]) as log:
        for k in range(4):
            log.append({"b": k, "a": "é"})
        assert log.syncs == 1 and len((tmp_path / "e.jsonl").read_text().splitlines()) == 3
        now[0] = 11.0
        log.append({"b": 4, "a": "é"})
        assert log.syncs == 2
    assert (tmp_path / "e.jsonl").read_text().splitlines()[4] == '{"a":"\\u00e9","b":4}'


def test_caches_and_bounds(spark, tmp_path):
    sinks.write_cache(spark.range(3), f"{tmp_path}/cache", {"model": "a", "n": 1})
    assert records.read_cache(spark, f"{tmp_path}/cache", {"n": 1, "model": "a"}).count() == 3
    with pytest.raises(ValueError, match="something else"):
        records.read_cache(spark, f"{tmp_path}/cache", {"model": "b", "n": 1})
    for k in range(2):
        (tmp_path / f"in{k}.jsonl").write_text(f'{{"a":{k}}}\n\n  \n{{"a":{k + 5}}}\n')
    (tmp_path / "in9.jsonl").write_text("broken\n")
    (tmp_path / "in").mkdir()
    for k in (0, 1, 9):
        (tmp_path / f"in{k}.jsonl").rename(tmp_path / f"in/{k}.jsonl")
    assert [r["a"] for r in records.json_lines(spark, f"{tmp_path}/in", "a long", max_records=3).collect()] == [0, 5, 1]
    with pytest.raises(Exception, match="not a record"):
        records.json_lines(spark, f"{tmp_path}/in", "a long").collect()
    assert records.json_lines(spark, f"{tmp_path}/in", "a long", strict=False).filter("not _valid").count() == 1
    (tmp_path / "r.json").write_text('{"a": 1, "b": 2}')
    with pytest.raises(Exception, match="not a record"):
        records.results(spark, f"{tmp_path}/r.json", "a long").collect()


def test_mixes(spark, tmp_path):
    m = lambda *t: [{"role": r, "content": x} for r, x in t]
    schema = "source string, idx long, messages array<struct<role string, content string>>"
    good, bad = m(("user", "a"), ("assistant", "b")), m(("assistant", "b"))
    rows = [("a", i, good) for i in range(10)] + [("b", i, bad if i == 0 else good) for i in range(20)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/sft")
    assert c.prepare_sft_mix(spark, f"{tmp_path}/sft", f"{tmp_path}/mix", 10, '{"b": 0.5}') == {"a": 5, "b": 5}
    mix = [json.loads(x) for p in sorted((tmp_path / "mix/records").glob("part-*")) for x in p.read_text().splitlines()]
    assert sorted(r["idx"] for r in mix if r["source"] == "b") == [1, 2, 3, 4, 5]
    lines = [canonical(r) for r in sorted(mix, key=lambda r: (r["idx"], canonical(r)))]
    h = hashlib.sha256(b"".join(len(x.encode()).to_bytes(8, "big") + x.encode() for x in lines)).hexdigest()
    manifest = json.loads((tmp_path / "mix/manifest.json").read_text())
    assert manifest["sha256"] == h and manifest["records"] == 10 and all(hashlib.sha256((tmp_path / "mix" / f["file"]).read_bytes()).hexdigest() == f["sha256"] for f in manifest["files"])

    schema = "idx long, prompt_id string, chosen array<struct<role string, content string>>, rejected array<struct<role string, content string>>, score_chosen double, score_rejected double"
    pairs = [(i, f"p{i}", m(("user", "q"), ("assistant", "y")), m(("user", "q"), ("assistant", "n")), 1.0, float("nan") if i == 8 else 0.0) for i in range(9)]
    spark.createDataFrame(pairs, schema).write.parquet(f"{tmp_path}/pref")
    assert c.prepare_preference_mix(spark, f"{tmp_path}/pref", f"{tmp_path}/pm", 5, 2027) == {"source": 9, "valid": 8, "rejected": 1, "selected": 5}
    assert c.prepare_preference_holdout(spark, f"{tmp_path}/pref", f"{tmp_path}/pm", f"{tmp_path}/ph") == {"selected": 3}
    taken, left = (spark.read.json(f"{tmp_path}/{n}/records").select("idx") for n in ("pm", "ph"))
    assert taken.intersect(left).count() == 0


def test_reports(spark, tmp_path):
    def put(folder, rows):
        for k, r in enumerate(rows):
            (tmp_path / folder / str(k)).mkdir(parents=True)
            (tmp_path / folder / str(k) / "result.json").write_text(json.dumps(r))

    cells = [{"architecture": "d", "cell": cell, "repetition": r, "throughput": t + r, "loss_delta": 0.0, "plan_sha256": "p", "trace_sha256": f"{cell}{r}", "baseline_trace_sha256": None if cell == "baseline" else f"baseline{r}"} for cell, t in (("baseline", 100.0), ("fast", 130.0), ("slow", 90.0)) for r in (1, 2, 3)]
    put("cal", cells)
    (tmp_path / "plan.jsonl").write_text("".join(json.dumps({k: x[k] for k in ("architecture", "cell", "repetition")}) + "\n" for x in cells))
    found = {r["cell"]: r["promoted"] for r in c.calibration_report(spark, f"{tmp_path}/cal/*/result.json", f"{tmp_path}/plan.jsonl")}
    assert found == {"baseline": False, "fast": True, "slow": False}
    put("cal2", cells[:-1])
    with pytest.raises(ValueError, match="plan and results"):
        c.calibration_report(spark, f"{tmp_path}/cal2/*/result.json", f"{tmp_path}/plan.jsonl")
    put("cal3", cells[1:])
    with pytest.raises(ValueError, match="baseline"):
        c.calibration_report(spark, f"{tmp_path}/cal3/*/result.json")
    put("cal5", [*cells[:-1], cells[-1] | {"baseline_trace_sha256": "other"}])
    with pytest.raises(ValueError, match="incompatible"):
        c.calibration_report(spark, f"{tmp_path}/cal5/*/result.json")
    with pytest.raises(ValueError, match="another plan"):
        c.calibration_report(spark, f"{tmp_path}/cal/*/result.json", plan_sha256="q")
    put("cal4", cells + cells[:1])
    with pytest.raises(ValueError, match="twice"):
        c.calibration_report(spark, f"{tmp_path}/cal4/*/result.json")

    base = {"hybrid": (0.5, 10.0), "mha": (1.0, 9.0), "norm": (2.0, 8.0), "tied": (2.5, 7.0), "gelu": (3.0, 50.0)}
    put("abl", [{"variant": v, "seed": s, "loss": loss + s / 1e5, "throughput": t} for v, (loss, t) in base.items() for s in c.SEEDS])
    report = c.ablation_report(spark, f"{tmp_path}/abl/*/result.json")
    assert [r["name"] for r in report if r["finalist"]] == ["hybrid", "mha", "norm", "gelu"] and [r["position"] for r in report] == [1, 2, 3, 4, 5]
    assert {r["name"]: r["throughput_rank"] for r in report} == {"gelu": 1, "hybrid": 2, "mha": 3, "norm": 4, "tied": 5}
    put("abl2", [{"variant": "x", "seed": 1, "loss": 1.0, "throughput": 1.0}])
    with pytest.raises(ValueError, match="three seeds"):
        c.ablation_report(spark, f"{tmp_path}/abl2/*/result.json")


def study(tmp_path):
    lineages = [{"architecture": a, "seed": s, "screening": {"optimizer_step": 12208, "tokens_consumed": 100_007_936}, "screening_checkpoint": f"{tmp_path}/ck-{s}", "model_config_sha256": "m", "training_config_sha256": f"t{s}"} for a in ("dense", "mamba2") for s in c.SEEDS]
    return {"shard_manifest_sha256": "s", "tokenizer_sha256": "k", "sequence_length": 1024, "micro_batch_size": 8, "gradient_accumulation_steps": 1, "screening_dense_reference_tokens": 100_000_000, "lineages": lineages}


def test_ablation_plan(spark, tmp_path):
    source, path = study(tmp_path), tmp_path / "study.json"
    (tmp_path / "ck-1337").mkdir()
    path.write_text(json.dumps(source))
    plan = c.plan_ablations(spark, f"{path}")
    assert len(plan["jobs"]) == 24 and len(plan["variants"]) == 8
    assert [j["execution_status"] for j in plan["jobs"][:4]] == ["reuse_screening", "requires_checkpoint_recovery", "requires_checkpoint_recovery", "ready_for_bounded_smoke"]
    assert plan["jobs"][0]["training_config_sha256"] == "t1337" and plan["jobs"][3]["model_config_sha256"] is None
    assert plan["jobs"][-1]["optimizer_variant"] == "hybrid_muon" and {j["expected_optimizer_step"] for j in plan["jobs"]} == {12208}
    for change, message in ((lambda s: s["lineages"].pop(0), "three seeds"), (lambda s: s.update(sequence_length=512), "1024"), (lambda s: s.update(screening_dense_reference_tokens=5), "screen must"), (lambda s: s["lineages"][0]["screening"].update(optimizer_step=1), "different steps")):
        bad = study(tmp_path)
        change(bad)
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError, match=message):
            c.plan_ablations(spark, f"{path}")


def test_downstream_report(spark, tmp_path):
    job = {"variant": "layer_norm", "seed": 2027, "model_config_sha256": "m", "shard_manifest_sha256": "s", "tokenizer_sha256": "k"}
    evaluation = {"split": "validation", "batch_count": 24, "sequence_count": 192, "predicted_token_count": 196_416, "model_config_sha256": "m", "shard_manifest_sha256": "s", "tokenizer_sha256": "k", "mean_loss": 2.0}
    generation = {"model_config_sha256": "m", "tokenizer_sha256": "k", "result": {"generated_token_count": 16, "model_forwards": 16}}

    def run(jobs=(job,), e=evaluation, g=generation, dirty=False):
        top = tmp_path / str(len(list(tmp_path.iterdir())))
        for name, record in (("e", e), ("g", g)):
            (top / name).mkdir(parents=True)
            (top / name / "x-layer-norm-2027-v24.jsonl").write_text("".join(canonical(r) + "\n" for r in (record if isinstance(record, list) else [record])))
        (top / "report.json").write_text(json.dumps({"recommended_variants": ["layer_norm"], "jobs": list(jobs), "source_dirty": dirty}))
        return c.ablation_downstream_report(spark, f"{top}/report.json", f"{top}/e", f"{top}/g")

    assert run()[0]["evaluation"]["mean_loss"] == 2.0
    for bad, message in ((dict(jobs=(job, job)), "2 jobs"), (dict(jobs=()), "0 jobs"), (dict(e=evaluation | {"tokenizer_sha256": "x"}), "bind"), (dict(e=evaluation | {"batch_count": 3}), "bind"), (dict(g=generation | {"result": {"generated_token_count": 15, "model_forwards": 16}}), "bind"), (dict(e=[evaluation, evaluation]), "2 records"), (dict(dirty=True), "changed source")):
        with pytest.raises(ValueError, match=message):
            run(**bad)


def test_smoke_report(spark, tmp_path):
    config = {"device": "cuda", "precision": "bf16", "compile_model": True}
    start = {"event": "run_start", "training_config_sha256": "c", "training_config": config}
    events = [start, step(1), {"event": "run_resume", "training_config_sha256": "c"}, step(2)]
    common = {"model_config_sha256": "m", "tokenizer_sha256": "k"}
    point = {"binding": common | {"architecture": "masked_diffusion", "shard_manifest_sha256": "s", "git": {"dirty": False, "revision": "r"}, "runtime": {"cuda_available": True, "cuda_version": "12"}}, "progress": {"optimizer_step": 2, "tokens_consumed": 16}, "lineage": {"checkpoint_id": "step-000000000002", "parent_checkpoint_id": "step-000000000001"}, "created_at_utc": "2026-01-01T00:00:05Z"}
    named = {"source_checkpoint_id": "step-000000000002"}

    def run(family="bidirectional", events=events, point=point, e=None, x=None, g=None):
        top = tmp_path / str(len(list(tmp_path.iterdir())))
        top.mkdir()
        own = named | {"source_checkpoint_manifest_sha256": digest(point)}
        e = common | own | {"shard_manifest_sha256": "s", "evaluated_at_utc": "2026-01-01T00:00:09Z"} | (e or {})
        x, g = common | own | (x or {}), common | own | {"generated_at_utc": "2026-01-01T00:00:07Z"} | (g or {})
        (top / "log").write_text("".join(canonical(v) + "\n" for v in events))
        for name, v in (("point", point), ("e", e), ("x", x), ("g", g)):
            (top / name).write_text(canonical(v) + "\n")
        return c.smoke_report(spark, family, *(f"{top}/{n}" for n in ("log", "point", "e", "x", "g")))

    got = run()
    assert got["recorded_at_utc"] == "2026-01-01T00:00:09Z" and got["final_tokens_consumed"] == 16 and len(got["training_steps"]) == 2
    changed = lambda **more: point | {"binding": point["binding"] | more}
    assert run("dense", point=changed(architecture="olmo2"))["architecture"] == "olmo2"
    assert run("state_space", point=changed(architecture="mamba2"))["architecture"] == "mamba2"
    bad = [
        (dict(events=events[1:]), "one start and one resume"),
        (dict(events=[*events, events[2]]), "one start and one resume"),
        (dict(events=[start | {"training_config_sha256": "d"}, *events[1:]]), "changed across"),
        (dict(events=[start | {"training_config": config | {"precision": "fp32"}}, *events[1:]]), "bf16"),
        (dict(events=[start, step(1), events[2], step(3)]), "not contiguous"),
        (dict(family="dense"), "another architecture"),
        (dict(point=changed(git={"dirty": True, "revision": "r"})), "changed source"),
        (dict(point=point | {"progress": {"optimizer_step": 3, "tokens_consumed": 16}}), "don't reach"),
        (dict(point=point | {"progress": {"optimizer_step": 2, "tokens_consumed": 17}}), "tokens"),
        (dict(point=point | {"lineage": point["lineage"] | {"parent_checkpoint_id": None}}), "no parent"),
        (dict(g={"model_config_sha256": "n"}), "model configuration hashes"),
        (dict(e={"tokenizer_sha256": "n"}), "tokenizer hashes"),
        (dict(e={"shard_manifest_sha256": "n"}), "other shards"),
        (dict(x={"source_checkpoint_id": "n"}), "export names another checkpoint"),
        (dict(g={"source_checkpoint_manifest_sha256": "n"}), "generation names another checkpoint manifest"),
        (dict(point=changed(runtime={"cuda_available": False, "cuda_version": None})), "accelerator"),
    ]
    for change, message in bad:
        with pytest.raises(ValueError, match=message):
            run(**change)


def test_rollups_cells_and_dry_runs(spark, tmp_path):
    spark.createDataFrame([("r", 2.0, 100), ("r", 1.0, 300)], "run string, loss double, tokens long").write.parquet(f"{tmp_path}/c")
    assert c.evaluation_rollup(spark, "causal", f"{tmp_path}/c")[0]["mean_loss"] == 1.25
    spark.createDataFrame([("r", 1.0, 2.0, 4, 1, 1), ("r", 3.0, 1.0, 12, 7, 3)], "run string, weighted_loss double, token_loss double, masked long, correct long, examples long").write.parquet(f"{tmp_path}/d")
    assert c.evaluation_rollup(spark, "diffusion", f"{tmp_path}/d")[0] == {"run": "r", "loss": 2.5, "masked_loss": 1.25, "masked_accuracy": 0.5, "masked": 16, "examples": 4}
    spark.createDataFrame([("sft", 1.0, 0.0, 3, 4, True), ("sft", 1.0, 1.0, 5, 4, False)], "role string, chosen double, rejected double, chosen_tokens long, rejected_tokens long, truncated boolean").write.parquet(f"{tmp_path}/p")
    assert c.evaluation_rollup(spark, "preference", f"{tmp_path}/p")[0]["accuracy"] == 0.5
    cells = [{"architecture": "dense", "cell": x} for x in ("baseline", "fast")]
    (tmp_path / "plan.json").write_text(json.dumps({"cells": cells}))
    assert c.inspect_cell(spark, f"{tmp_path}/plan.json", "dense", "fast") == cells[1]
    (tmp_path / "plan.jsonl").write_text("".join(json.dumps(x) + "\n" for x in [*cells, cells[0]]))
    for cell, n in (("none", 0), ("baseline", 2)):
        with pytest.raises(ValueError, match=f"planned {n} times"):
            c.inspect_cell(spark, f"{tmp_path}/plan.jsonl", "dense", cell)
    plan = c.pretrain_plan(spark, "dense", '{"vocab": 100, "hidden": 8, "layers": 2, "kv": 4, "mlp": 16}', 10_000, 16, 4, 2, 2, 3, 100.0)
    assert plan["optimizer_steps"] == 40 and plan["training_tokens"] == 10_240 and plan["seconds"] == 102.4 and plan["retained_bytes"] == 48 * plan["parameters"]


def test_plans_and_comparison(spark, tmp_path):
    plan = c.plan_study(spark, '{"dense": 1000, "state_space": 900}', 1_000_000, 1000)
    assert len(plan) == 6 and all(p["within_window"] for p in plan)
    assert len(c.plan_calibration(spark, '["baseline", "fast"]')) == 6
    own = c.model_summary(spark, "dense", '{"vocab": 100, "hidden": 8, "layers": 2, "kv": 4, "mlp": 16}', 16)
    assert own["parameters"] == 2 * 800 + 2 * (2 * 64 + 2 * 32) + 2 * 3 * 8 * 16 + 2 * (3 * 8 + 4) + 8
    a = spark.createDataFrame([("w", i, float(i)) for i in range(5)], "tensor string, idx long, value double")
    a.write.parquet(f"{tmp_path}/a")
    a.withColumn("value", F.when(F.col("idx") == 3, 3.1).otherwise(F.col("value"))).write.parquet(f"{tmp_path}/b")
    assert c.compare_runs(spark, f"{tmp_path}/a", f"{tmp_path}/a")[0]["passed"]
    assert c.compare_runs(spark, f"{tmp_path}/a", f"{tmp_path}/b")[0]["violations"] == 1


def test_command_line(spark, capsys):
    c.main(["plan-calibration", "--cells", '["x"]', "--repetitions", "2"])
    assert json.loads(capsys.readouterr().out) == [{"cell": "x", "repetition": 1}, {"cell": "x", "repetition": 2}]
