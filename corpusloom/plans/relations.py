"""Joins, set operations, splits, sinks and log figures."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import runtime
from corpusloom.functions import text as T
from corpusloom.operators import batching, joins, metrics, split
from corpusloom.plans import sqltext as Q
from corpusloom.sources import shards, sinks


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def labels(spark: SparkSession, sf: str, name: str = "train_clips") -> DataFrame:
    """One label row per id: rows repeated whole are one."""
    return read(spark, sf, name).select("id", "cleaned_text").distinct()


def guarded(spark, sf):
    """Labels of validation clips that are in no other split, attached to their clips behind every guard: columns, unique
    ids, no leak between the splits, coverage, no empty side, no blank label."""
    train, val = labels(spark, sf), labels(spark, sf, "val_clips")
    own = val.join(joins.leaked(val, train), "id", "left_anti").filter(F.trim(T.collapsed(F.col("cleaned_text"))) != "")
    clips = read(spark, sf, "raw_clips").select("id", "duration")
    joins.check_no_leakage(train, own)
    joins.check_coverage(own, clips)
    joins.check_not_empty(train=train, val=own)
    return joins.attach(clips, shards.usable_labels(own))


def attached(spark, sf):
    return joins.attach(read(spark, sf, "raw_clips").select("id", "duration"), labels(spark, sf))


def routed(spark, sf):
    return joins.routed(read(spark, sf, "raw_clips").select("id"), {"train": read(spark, sf, "train_clips"), "val": read(spark, sf, "val_clips")})


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one, deleted when the driver ends."""
    path = f"{runtime.shared_dir(spark)}/corpusloom-{uuid.uuid4().hex}"
    runtime._scratch.append((spark, path))
    return path


def csv_round_trip(spark, sf):
    """Labels written as CSV into the shared folder and read back."""
    path = scratch(spark)
    sinks.write_csv(read(spark, sf, "train_clips").select("id", "duration", "text_raw", "cleaned_text"), path)
    return shards.read_labels(spark, path)


def parquet_round_trip(spark, sf):
    path = scratch(spark)
    sinks.write_parquet(read(spark, sf, "val_clips").select("id", "duration", "cleaned_text", "split"), path)
    return spark.read.parquet(path)


def json_round_trip(spark, sf):
    """Results as JSON lines with their nulls, read back."""
    path = scratch(spark)
    sinks.write_json(read(spark, sf, "val_clips").select("id", "duration", "cleaned_text", "split"), path)
    return spark.read.schema("id bigint, duration double, cleaned_text string, split string").json(path)


PARTS = 3


def as_shards(spark, sf, folder: str) -> None:
    """The raw clips as shards in folders of different depth, by id."""
    raw = read(spark, sf, "raw_clips").select("id", "audio", F.col("text_raw").alias("text"), "duration")
    for k in range(PARTS):
        raw.filter(F.pmod("id", F.lit(PARTS)) == k).write.parquet(f"{folder}/" + "/".join(f"level{k}{d}" for d in range(4 * k + 1)))


def shard_scan(spark, sf):
    folder = scratch(spark)
    as_shards(spark, sf, folder)
    return shards.read_shards(spark, folder, ("id", "text", "duration"), pattern="part-*.parquet").select("id", "text_raw", "duration")


def shard_first(spark, sf):
    """Only as many shards as lie in the first folder."""
    folder = scratch(spark)
    as_shards(spark, sf, folder)
    n = sum("level00" in f for f in shards.shard_files(spark, folder, "part-*.parquet"))
    return shards.read_shards(spark, folder, ("id", "text", "duration"), n, pattern="part-*.parquet").select("id", "text_raw", "duration")


def token_rows(spark, sf):
    """Arrays of word lengths as stand-ins for tokens, in batches of 16 ids."""
    t = F.transform(T.words(T.null_safe(F.col("cleaned_text"))), lambda w: F.length(w))
    return read(spark, sf, "train_clips").select("id", t.alias("labels"), F.floor(F.col("id") / 16).alias("batch")).distinct()


def as_text(labels_):
    return F.array_join(F.transform(labels_, lambda x: x.cast("string")), ",").alias("labels")


def padded(spark, sf):
    return batching.padded(token_rows(spark, sf), "labels", "batch").select("id", as_text("labels"))


def without_start(spark, sf):
    return batching.without_start(token_rows(spark, sf), "labels", "batch", 4).select("id", as_text("labels"))


def unmasked(spark, sf):
    p = batching.padded(token_rows(spark, sf), "labels", "batch")
    return p.select("id", as_text(batching.unmasked(batching.truncated(F.col("labels")), 0)))


def truncated(spark, sf):
    """Code points of documents as stand-ins for tokens, cut to the most labels that a decoder takes."""
    points = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.ascii(c))
    return read(spark, sf, "documents").select("doc_id", F.size(points).alias("n"), as_text(batching.truncated(points)))


STEPS, SAMPLES, ALL_STEPS, REFERENCE, BASELINE = 100, 300, 6267, 8.02, "Supplier#000000005"
_MANY = "\n".join(["  File \"run\", line 7", "", " ", "ValueError: " + "x" * 200, "a", "b", "c", "d", ""])


def logs(spark: SparkSession, sf: str) -> DataFrame:
    """A training log for each supplier, made from its columns: finished runs in both styles of quoting, runs out of
    memory, without evaluation, and failed ones."""
    kind = F.col("s_suppkey") % 5
    number = lambda c: c.cast("string")
    total, spent = number(F.col("s_suppkey") + 800), number(F.col("s_nationkey") + 60)
    done = F.concat(F.lit("step 1\n{'train_runtime': '"), total, F.lit(".5', 'epoch': 1}\n{'eval_runtime':  "), spent, F.lit(".25, 'eval_wer': 31.25, 'eval_cer':'9.5'}\n[PEAK VRAM] 11.75 GiB\n\n"))
    log = F.when(kind == 0, done).when(kind == 1, F.lit("loading\ntorch.OutOfMemoryError: CUDA out of memory\n"))
    log = log.when(kind == 2, F.concat(F.lit("{'train_runtime': "), total, F.lit(", 'loss': 0.5}\n[PEAK VRAM]  9.5 GiB\n"))).when(kind == 3, F.lit(_MANY)).otherwise(F.lit(""))
    return read(spark, sf, "supplier").select(F.col("s_name").alias("name"), log.alias("log"))


def parsed_logs(spark: SparkSession, sf: str) -> DataFrame:
    cols = [T.number_after(F.col("log"), p).alias(n) for n, p in T.LOG_FIELDS.items()]
    return logs(spark, sf).select("name", *cols, F.col("log").contains(T.OUT_OF_MEMORY).alias("oom"), F.array_join(T.last_lines(F.col("log")), " | ").alias("tail"))


def projection(spark, sf):
    out = metrics.against_baseline(metrics.run_times(parsed_logs(spark, sf), STEPS, SAMPLES), BASELINE, ALL_STEPS, REFERENCE)
    return out.select("name", *[F.round(c, 9).alias(c) for c in ("s_per_step", "s_per_eval_sample", "speedup", "hours", "reference_hours")])


def chosen_runs(spark, sf):
    return metrics.chosen(parsed_logs(spark, sf), f"{BASELINE}, Supplier#000000001").select("name", "train_runtime", "oom")


QUERIES = {
    "label_attach": attached,
    "split_route": routed,
    "unmatched": lambda spark, sf: joins.unmatched(labels(spark, sf), read(spark, sf, "raw_clips")),
    "leakage": lambda spark, sf: joins.leaked(read(spark, sf, "train_clips"), read(spark, sf, "val_clips")),
    "id_union": lambda spark, sf: joins.id_union(read(spark, sf, "train_clips"), read(spark, sf, "val_clips")),
    "shard_union": lambda spark, sf: joins.stacked(read(spark, sf, "train_clips").drop("source"), read(spark, sf, "val_clips").drop("source", "split")),
    "id_difference": lambda spark, sf: joins.difference(read(spark, sf, "raw_clips"), read(spark, sf, "train_clips")),
    "train_val_split": lambda spark, sf: split.train_val(read(spark, sf, "documents").select("doc_id"), "doc_id"),
    "seeded_subset": lambda spark, sf: split.subset(read(spark, sf, "documents").select("doc_id", "source"), "doc_id", 500),
    "csv_roundtrip": csv_round_trip,
    "pad_labels": padded,
    "strip_start_token": without_start,
    "unmask_truncate": unmasked,
    "truncate_labels": truncated,
    "guarded_labels": guarded,
    "label_coverage": lambda spark, sf: joins.coverage(labels(spark, sf), read(spark, sf, "val_clips")),
    "parquet_roundtrip": parquet_round_trip,
    "json_roundtrip": json_round_trip,
    "shard_scan": shard_scan,
    "shard_first": shard_first,
    "log_metrics": parsed_logs,
    "runs_chosen": chosen_runs,
    "runtime_projection": projection,
}

_TOK = "tok AS (SELECT DISTINCT id, list_transform(list_filter(regexp_split_to_array(coalesce(cleaned_text, ''), '[\\t-\\r\\x1c-\\x20\\x85\\p{Z}]+'), lambda w: w <> ''), lambda w: length(w)) AS l, id // 16 AS batch FROM train_clips)"
_PAD = "pad AS (SELECT id, list_concat(l, list_transform(range(max(len(l)) OVER (PARTITION BY batch) - len(l)), lambda i: -100)) AS l FROM tok)"
_Q = lambda t: "'" + t.replace("'", "''") + "'"
_LOG = f"""SELECT s_name AS name, CASE s_suppkey % 5 WHEN 0 THEN {_Q("step 1" + chr(10) + "{'train_runtime': '")} || (s_suppkey + 800) || {_Q(".5', 'epoch': 1}" + chr(10) + "{'eval_runtime':  ")} || (s_nationkey + 60) || {_Q(".25, 'eval_wer': 31.25, 'eval_cer':'9.5'}" + chr(10) + "[PEAK VRAM] 11.75 GiB" + 2 * chr(10))}
    WHEN 1 THEN {_Q("loading" + chr(10) + "torch.OutOfMemoryError: CUDA out of memory" + chr(10))} WHEN 2 THEN {_Q("{'train_runtime': ")} || (s_suppkey + 800) || {_Q(", 'loss': 0.5}" + chr(10) + "[PEAK VRAM]  9.5 GiB" + chr(10))} WHEN 3 THEN {_Q(_MANY)} ELSE '' END AS log FROM supplier"""
_PARSED = "SELECT name, log, " + ", ".join(f"TRY_CAST(nullif(regexp_extract(log, {_Q(p)}, 1), '') AS DOUBLE) AS {n}" for n, p in T.LOG_FIELDS.items()) + f" FROM ({_LOG})"

SQL = {
    "label_attach": "SELECT r.id, r.duration, l.cleaned_text FROM raw_clips r JOIN (SELECT DISTINCT id, cleaned_text FROM train_clips) l USING (id)",
    "split_route": "SELECT r.id, CASE WHEN id IN (SELECT id FROM train_clips) THEN 'train' WHEN id IN (SELECT id FROM val_clips) THEN 'val' ELSE 'unused' END AS split FROM raw_clips r",
    "unmatched": "SELECT DISTINCT id, cleaned_text FROM train_clips WHERE id NOT IN (SELECT id FROM raw_clips)",
    "leakage": "SELECT id FROM train_clips INTERSECT SELECT id FROM val_clips",
    "id_union": "SELECT id FROM train_clips UNION SELECT id FROM val_clips",
    "shard_union": "SELECT id, duration, text_raw, cleaned_text, speaker_id, recording_id FROM train_clips UNION ALL SELECT id, duration, text_raw, cleaned_text, speaker_id, recording_id FROM val_clips",
    "id_difference": "SELECT id FROM raw_clips EXCEPT SELECT id FROM train_clips",
    "train_val_split": "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(concat('42:', doc_id)), doc_id) <= ceil(0.15 * (SELECT count(*) FROM documents)) THEN 'val' ELSE 'train' END AS split FROM documents",
    "seeded_subset": "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (ORDER BY md5(concat('42:', doc_id)), doc_id) <= 500",
    "csv_roundtrip": "SELECT id, duration, nullif(text_raw, '') AS text_raw, nullif(cleaned_text, '') AS cleaned_text FROM train_clips",
    "pad_labels": f"WITH {_TOK}, {_PAD} SELECT id, array_to_string(l, ',') AS labels FROM pad",
    "strip_start_token": f"WITH {_TOK} SELECT id, array_to_string(CASE WHEN bool_and(coalesce(l[1] = 4, false)) OVER (PARTITION BY batch) THEN l[2:] ELSE l END, ',') AS labels FROM tok",
    "unmask_truncate": f"WITH {_TOK}, {_PAD} SELECT id, array_to_string(list_transform(l[1:448], lambda x: CASE WHEN x = -100 THEN 0 ELSE x END), ',') AS labels FROM pad",
    "truncate_labels": "SELECT doc_id, length(text)::INT AS n, array_to_string(list_transform(list_filter(string_split(text, ''), lambda c: c <> '')[1:448], lambda c: unicode(c)), ',') AS labels FROM documents",
    "guarded_labels": f"""SELECT r.id, r.duration, l.cleaned_text FROM raw_clips r JOIN (SELECT DISTINCT id, cleaned_text FROM val_clips WHERE id NOT IN (SELECT id FROM train_clips) AND {Q.collapsed('cleaned_text')} <> '') l USING (id)""",
    "label_coverage": "SELECT count(*) AS n_labels, count(*) FILTER (id NOT IN (SELECT id FROM val_clips)) AS n_missing, 'some' AS covered FROM (SELECT DISTINCT id, cleaned_text FROM train_clips)",
    "parquet_roundtrip": "SELECT id, duration, cleaned_text, split FROM val_clips",
    "json_roundtrip": "SELECT id, duration, cleaned_text, split FROM val_clips",
    "shard_scan": "SELECT id, coalesce(text_raw, '') AS text_raw, duration FROM raw_clips",
    "shard_first": f"SELECT id, coalesce(text_raw, '') AS text_raw, duration FROM raw_clips WHERE id % {PARTS} = 0",
    "log_metrics": f"""SELECT name, {", ".join(T.LOG_FIELDS)}, contains(log, 'OutOfMemoryError') AS oom,
        array_to_string(list_transform(list_filter(string_split(log, chr(10)), lambda x: trim(x) <> '')[-6:], lambda x: substr(x, 1, 160)), ' | ') AS tail FROM ({_PARSED})""",
    "runs_chosen": f"SELECT name, train_runtime, contains(log, 'OutOfMemoryError') AS oom FROM ({_PARSED}) WHERE name IN ('{BASELINE}', 'Supplier#000000001')",
    "runtime_projection": f"""WITH t AS (SELECT name, (train_runtime - eval_runtime) / {STEPS} AS s_per_step, CASE WHEN train_runtime IS NOT NULL THEN eval_runtime / {SAMPLES} END AS s_per_eval_sample FROM ({_PARSED})),
        b AS (SELECT *, (SELECT max(s_per_step) FROM t WHERE name = '{BASELINE}') / s_per_step AS speedup FROM t)
        SELECT name, round(s_per_step, 9) AS s_per_step, round(s_per_eval_sample, 9) AS s_per_eval_sample, round(speedup, 9) AS speedup, round(s_per_step * {ALL_STEPS} / 3600.0, 9) AS hours, round({REFERENCE} / speedup * {ALL_STEPS} / 3600.0, 9) AS reference_hours FROM b""",
}
