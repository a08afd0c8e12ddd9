"""Publication and committed reads: shards, commits, ledgers, manifests and their audits."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from nightgrid import model as m
from nightgrid.functions.columns import finite
from nightgrid.functions.headers import path_is_safe, path_key
from nightgrid.operators import digests
from nightgrid.operators.audits import duplicates, problems
from nightgrid.session import table_options

COMMIT_SCHEMA = ("shard_id string, run_id string, artifact string, epochs bigint, digest string, status string")


def row_digest(df: DataFrame, shard: str, columns: Sequence[str]) -> DataFrame:
    """Order-free digest and row count per shard; partial sums, no sorting, any shard size."""
    h = F.xxhash64(*columns)
    out = df.groupBy(shard).agg(
        F.count("*").alias("epochs"), F.bit_xor(h).alias("_x"),
        F.sum(h.cast("decimal(20,0)")).alias("_s"))
    return out.select(shard, "epochs", F.sha2(F.concat_ws(
        ":", F.col("epochs").cast("string"), F.col("_x").cast("string"), F.col("_s").cast("string")), 256).alias("digest"))


def index_digest(epochs: DataFrame, shard: str = "shard_id", block: int = 1024) -> DataFrame:
    """SHA-256 over ordered epoch keys, built as a tree so that no list exceeds a block."""
    leaf = F.sha2(F.concat_ws(":", "recording_id", F.col("epoch_in_record").cast("string"),
                              F.col("epoch_start_offset_ns").cast("string")), 256)
    rows = epochs.select(shard, "recording_id", F.floor(F.col("epoch_in_record") / block).alias("_b"),
                         F.col("epoch_in_record").alias("_e"), leaf.alias("_h"))

    def fold(df, keys, order):
        ordered = F.array_sort(F.collect_list(F.struct(*order, "_h")))
        return df.groupBy(*keys).agg(F.sha2(F.concat_ws(",", F.transform(ordered, lambda s: s["_h"])), 256).alias("_h"))

    blocks = fold(rows, [shard, "recording_id", "_b"], ["_e"])
    records = fold(blocks, [shard, "recording_id"], ["_b"])
    # A shard may hold any number of records: their hashes are folded by leading digits first.
    leading = records.withColumn("_g", F.substring(F.sha2(F.col("recording_id").cast("string"), 256), 1, 3))
    groups = fold(leading, [shard, "_g"], ["recording_id"])
    return fold(groups, [shard], ["_g"]).withColumnRenamed("_h", "index_digest")


def write_table(df: DataFrame, path: str, shard: str = "shard_id", order: Sequence[str] = ()) -> None:
    """Long table partitioned by shard, record-contiguous inside each file.

    Rebalancing lets adaptive execution cut an oversized shard into several files and join
    small ones, whatever share of the rows one shard or recording has.
    """
    (df.hint("rebalance", shard).sortWithinPartitions(shard, *order)
     .write.mode("append").options(**table_options(df)).partitionBy(shard).parquet(path))


def write_signals(df: DataFrame, path: str) -> None:
    write_table(df, path, order=("recording_id", "epoch_in_record", "channel"))


def read_commits(spark: SparkSession, root: str) -> DataFrame:
    """Commit rows of all runs; none before the first run."""
    try:
        return spark.read.schema(COMMIT_SCHEMA).parquet(f"{root}/commits")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT_SCHEMA)


def default_gates() -> dict[str, Callable[[DataFrame], DataFrame]]:
    """What a stored artifact must pass: each audit returns rows with the recording_id of what is wrong."""
    from nightgrid.operators import audits

    def signals(df: DataFrame) -> DataFrame:
        finite_samples = problems(df, ["recording_id"], {"finite": F.forall("samples", lambda x: finite(x.cast("double")))})
        index = audits.index_violations(df, ["recording_id", "channel"])
        return finite_samples.select("recording_id").unionByName(index.select("recording_id"))

    def qc(df: DataFrame) -> DataFrame:
        found = [audit(df).select("recording_id") for audit in (audits.flag_violations, audits.code_violations, audits.mask_violations)]
        return found[0].unionByName(found[1]).unionByName(found[2])

    return {"signal_epochs": signals, "qc_epochs": qc, "task_epochs": audits.task_code_violations, "records": whole_records}


def whole_records(records: DataFrame) -> DataFrame:
    """Records listed twice, without epochs, or with a grade outside 1-5."""
    checks = {"n_epochs": F.col("n_epochs") > 0}
    if "night_grade" in records.columns:
        checks["night_grade"] = F.col("night_grade").between(1, 5)
    return problems(records, ["recording_id"], checks).select("recording_id").unionByName(
        duplicates(records, ["recording_id"]).select("recording_id"))


def publish(root: str, tables: dict[str, DataFrame], digest_columns: dict[str, Sequence[str]] | None = None,
            gates: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> str:
    """Write every uncommitted shard of every artifact, audit it, then commit it.

    A run writes below its own run id and commits with one file, which appears whole or not at
    all; until then readers see nothing of it, so a lost job leaves no half-published shard and a
    re-run starts from the same state. A shard is done per artifact, so an artifact added later is written for old
    shards too. Digests cover every stored column unless columns are named. What was stored must pass its gate; a
    shard with a violation is committed as QC_FAILED, stays invisible, and is written again by the next run.
    """
    spark = next(iter(tables.values())).sparkSession
    run_id, gates = uuid.uuid4().hex, default_gates() if gates is None else gates
    done = read_commits(spark, root).where("status = 'QC_PASSED'").select("artifact", "shard_id").distinct()
    commits = None
    for name, df in tables.items():
        committed = done.where(F.col("artifact") == name).select("shard_id")
        pending = df.withColumn("shard_id", F.col("shard_id").cast("string")).join(committed, "shard_id", "left_anti")
        path = f"{root}/{name}/run_id={run_id}"
        order = [c for c in ("recording_id", "epoch_in_record", "channel", "task") if c in df.columns]
        write_table(pending, path, order=order)
        # Digests and audits look at what was stored, not at the plan that produced it.
        stored = spark.read.schema(pending.schema).parquet(path)
        columns = (digest_columns or {}).get(name) or sorted(stored.columns)
        rows = row_digest(stored, "shard_id", list(columns))
        if name in gates:
            wrong = gates[name](stored).select("recording_id").distinct()
            failed = stored.select("shard_id", "recording_id").join(wrong, "recording_id", "left_semi").select("shard_id").distinct()
            rows = rows.join(failed.withColumn("_failed", F.lit(True)), "shard_id", "left")
        else:
            rows = rows.withColumn("_failed", F.lit(None).cast("boolean"))
        status = F.when(F.col("_failed"), "QC_FAILED").otherwise("QC_PASSED")
        rows = rows.select("shard_id", F.lit(run_id).alias("run_id"), F.lit(name).alias("artifact"), "epochs", "digest", status.alias("status"))
        commits = rows if commits is None else commits.unionByName(rows)
    commits.coalesce(1).write.mode("append").parquet(f"{root}/commits")  # one row a shard and artifact
    return run_id


def visible(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The commit that readers follow for each shard of an artifact: of several runs, one."""
    passed = read_commits(spark, root).where((F.col("artifact") == name) & (F.col("status") == "QC_PASSED"))
    return passed.groupBy("shard_id").agg(F.min_by(F.struct("run_id", "epochs", "digest"), "run_id").alias("_c")).select("shard_id", "_c.*")


def _stored(spark: SparkSession, root: str, name: str, *paths: str) -> DataFrame:
    """All rows of an artifact, or of some of its files, with run_id and shard_id as the text they are, leading zeros and all."""
    files, paths = spark.read.option("basePath", f"{root}/{name}"), paths or (f"{root}/{name}",)
    found = files.parquet(*paths).schema
    keys = ("run_id", "shard_id")
    schema = StructType([StructField(f.name, StringType()) if f.name in keys else f for f in found])
    return files.schema(schema).parquet(*paths)


def damaged_shards(spark: SparkSession, root: str, name: str, digest_columns: Sequence[str] | None = None) -> DataFrame:
    """Visible shards whose stored rows no longer give the committed digest: shard_id, run_id."""
    keys = visible(spark, root, name)
    data = _stored(spark, root, name).join(keys.select("run_id", "shard_id"), ["run_id", "shard_id"], "left_semi")
    columns = digest_columns or sorted(c for c in data.columns if c != "run_id")
    now = row_digest(data, "shard_id", list(columns)).select("shard_id", F.col("digest").alias("_now"))
    return keys.join(now, "shard_id", "left").where(~F.col("digest").eqNullSafe(F.col("_now"))).select("shard_id", "run_id")


#: Visible shards up to which a reader may hold their names.
PINNED_SHARDS = 10_000


def read_published(spark: SparkSession, root: str, name: str, verify: bool = False,
                   digest_columns: Sequence[str] | None = None, pinned: bool = False) -> DataFrame:
    """Rows of committed shards, each from one run; ``verify`` reads them twice and leaves out damaged shards.

    ``pinned`` looks the visible shards up now and reads their folders by name, whatever is committed later; each read
    then is a scan of the folders it needs, without a join. Above ``PINNED_SHARDS`` shards it joins as without.
    """
    keys = visible(spark, root, name).select("run_id", "shard_id")
    if verify:
        keys = keys.join(damaged_shards(spark, root, name, digest_columns), ["run_id", "shard_id"], "left_anti")
    found = keys.limit(PINNED_SHARDS + 1).collect() if pinned else []
    if not pinned or len(found) > PINNED_SHARDS:
        return _stored(spark, root, name).join(keys, ["run_id", "shard_id"], "left_semi").drop("run_id")
    by_run: dict[str, list[str]] = {}
    for run_id, shard_id in found:
        by_run.setdefault(run_id, []).append(shard_id)
    chosen = F.lit(False)
    for run_id, shards in by_run.items():
        chosen = chosen | ((F.col("run_id") == run_id) & F.col("shard_id").isin(shards))
    return _stored(spark, root, name).where(chosen).drop("run_id")


def visible_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(path, bytes, file) of the files of visible shards; ``file`` is the path relative to the artifact."""
    folder = lambda key: F.concat(F.lit(f"{key}="), key)
    shown = visible(spark, root, name).select(folder("run_id").alias("_run"), folder("shard_id").alias("_shard"))
    listed = digests.stored_files(spark, f"{root}/{name}", "*.parquet")
    listed = listed.withColumn("file", F.element_at(F.split("path", f"/{name}/(?=run_id=)"), -1))
    part = lambda i: F.element_at(F.split("file", "/"), i)
    return listed.withColumns({"_run": part(1), "_shard": part(2)}).join(shown, ["_run", "_shard"], "left_semi").drop("_run", "_shard")


def seal(spark: SparkSession, root: str, name: str) -> None:
    """Store the block trees of the files of visible shards that have none yet, below ``root/trees``.

    Paths are kept relative to the artifact, so a release may be moved. A repeated run adds what is new.
    """
    listed, done = visible_files(spark, root, name), trees(spark, root, name)
    if done is not None:
        listed = listed.join(done.where("level = 0 AND node = 0").select(F.col("path").alias("file")), "file", "left_anti")
    nodes = digests.block_tree(listed.select("path", "bytes"))
    nodes = nodes.withColumn("path", F.element_at(F.split("path", f"/{name}/(?=run_id=)"), -1))
    nodes.write.mode("append").options(**table_options(nodes)).parquet(f"{root}/trees/{name}")


def trees(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """Stored nodes of an artifact's files, paths relative to it; None before the first seal."""
    try:
        return spark.read.parquet(f"{root}/trees/{name}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _one_intact(files: DataFrame, check: Callable[[DataFrame], list[str]]) -> str | None:
    """A file of (path, ...) whose footer is intact, looked for in growing lots in the order of their paths; None if there is none."""
    seen, lot = 0, 1
    while True:
        part = files.orderBy("path").offset(seen).limit(lot)
        found = check(digests.group_ranges(part, None))
        if found:
            return min(found)
        if part.count() < lot:
            return None
        seen, lot = seen + lot, min(2 * lot, PINNED_SHARDS)


def read_verified(spark: SparkSession, root: str, name: str, within: dict[str, tuple], trusted: DataFrame | None = None) -> DataFrame:
    """Committed rows with each named column in its closed interval, without those of files that are not as they were sealed.

    Row groups are found by their stored bounds. They and the footers are hashed, by whole blocks, and followed up the
    stored tree to its root, or to ``trusted`` (path relative to the artifact, digest) kept elsewhere; nothing is decoded before
    that, and nothing else of the release is read. Files without a tree count as damaged. The check runs when this is
    called, and the files it found intact are read by name: at most ``PINNED_SHARDS``, otherwise ask for less at a time.
    The schema is that of an intact file too, where none holds such rows of one with an intact footer; without any, an error.
    """
    nodes = trees(spark, root, name)
    if nodes is None:
        raise ValueError(f"{name} has not been sealed")
    files = visible_files(spark, root, name)
    whole = lambda df: df.withColumnRenamed("path", "file").join(files.select("file", "path"), "file").drop("file")

    def check(ranges: DataFrame) -> list[str]:
        checked = digests.check_ranges(whole(nodes), ranges, whole(trusted) if trusted is not None else None)
        fine = checked.groupBy("path").agg(F.bool_and("intact").alias("_fine")).where("_fine")
        return [r.path for r in fine.limit(PINNED_SHARDS + 1).collect()]

    intact = check(digests.group_ranges(files, within))
    if len(intact) > PINNED_SHARDS:
        raise ValueError("too many files for one verified read")
    shown = intact or [_one_intact(files, check)]
    if shown == [None]:
        raise ValueError(f"no file of {name} is as it was sealed")
    # The files that were checked are the files that are read.
    rows = _stored(spark, root, name, *shown)
    rows = rows.select("shard_id", *[c for c in rows.columns if c not in ("run_id", "shard_id")])
    if not intact:
        return rows.limit(0)
    for column, (low, high) in within.items():
        rows = rows.where(F.col(column).between(low, high))
    return rows


def check_release(version: str, status: str, tasks: Sequence[str] = (), schema: str | None = None) -> None:
    """Caller-level conditions of a readable release."""
    if version != m.RELEASE_VERSION or status not in m.RELEASE_STATUSES:
        raise ValueError("expected a completed release of the supported version")
    if schema is not None and schema not in m.RELEASE_SCHEMAS:
        raise ValueError(f"unsupported schema version {schema!r}")
    if len(set(tasks)) != len(tasks) or set(tasks) - set(m.TASK_FIELDS):
        raise ValueError(f"tasks must be a unique subset of {tuple(m.TASK_FIELDS)}")


def committed_records(records: DataFrame, artifacts: DataFrame, commits: DataFrame) -> DataFrame:
    """Readable records: passed QC, artifact listed, and the commit agrees with the list."""
    good = agreement(artifacts, commits).where("problem IS NULL").select("shard_id", F.col("epochs").alias("artifact_epochs"))
    return records.where(F.col("status") == "QC_PASSED").join(good, "shard_id")


def agreement(artifacts: DataFrame, commits: DataFrame) -> DataFrame:
    """Every listed artifact with what is wrong between list and commit, NULL if nothing."""
    c = commits.select("artifact", *[F.col(x).alias(f"_{x}") for x in ("bytes", "sha256", "epochs", "shard_id", "status")])
    same = F.lit(True)
    for x in ("bytes", "sha256", "epochs", "shard_id"):
        same = same & F.col(x).eqNullSafe(F.col(f"_{x}"))
    problem = (F.when(F.col("_status").isNull(), "not_committed").when(F.col("_status") != "QC_PASSED", "not_passed")
               .when(~same, "manifest_commit_differ").when(~path_is_safe(path_key(F.col("artifact"))), "unsafe_path"))
    return artifacts.join(c, "artifact", "left").select(*artifacts.columns, problem.alias("problem"))


def range_violations(records: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Record ranges that do not fit their artifact."""
    a = artifacts.select("shard_id", F.col("epochs").alias("_epochs"))
    end = F.col("first_epoch") + F.col("n_epochs")
    return (records.join(a, "shard_id", "left").where(F.col("_epochs").isNull() | (end > F.col("_epochs")))
            .drop("_epochs"))


def record_violations(records: DataFrame) -> DataFrame:
    """Duplicate recordings, impossible ranges, grades outside 1-5."""
    again = duplicates(records, ["recording_id"]).select("recording_id", F.lit("duplicate").alias("problem"))
    return problems(records, ["recording_id"], {
        "range": (F.col("first_epoch") >= 0) & (F.col("n_epochs") > 0),
        "grade": F.col("night_grade").between(1, 5)}).unionByName(again)


def pending_records(planned: DataFrame, published: DataFrame, key: str = "session_key") -> DataFrame:
    """Planned but not yet published."""
    return planned.join(published.select(key), key, "left_anti")


def recovery_plan(planned: DataFrame, published: DataFrame, order: str, key: str = "session_key",
                  **capacity) -> DataFrame:
    """Committed assignments stay; the rest is packed again, numbered after them."""
    from nightgrid.operators.batches import greedy_batches

    kept = planned.join(published.select(key, "shard_no"), key)
    base = published.agg((F.coalesce(F.max("shard_no"), F.lit(-1)) + 1).alias("_base"))
    again = greedy_batches(pending_records(planned, published, key), key, order, **capacity)
    again = (again.crossJoin(F.broadcast(base))  # one row
             .withColumn("shard_no", F.col("shard_no") + F.col("_base")).drop("_base", "position"))
    return kept.unionByName(again)


def release_ledger(published: DataFrame, excluded: DataFrame, failed: DataFrame,
                   key: str = "session_key", failure_order: str = "failed_at") -> DataFrame:
    """Published, excluded and failed records in one table; the last failure of a session counts.

    A failure disappears once its session is published.
    """
    last = (failed.groupBy(key).agg(F.max_by("error", failure_order).alias("reason"))
            .withColumn("status", F.lit("FAILED_PENDING_REVIEW"))
            .join(published.select(key), key, "left_anti"))
    ok = published.withColumn("status", F.lit("QC_PASSED"))
    return ok.unionByName(excluded, allowMissingColumns=True).unionByName(last, allowMissingColumns=True)


def release_totals(ledger: DataFrame, planned_shards: DataFrame) -> DataFrame:
    shards = planned_shards.agg(F.count_distinct("shard_no").alias("planned_shards"))
    return ledger.agg(
        F.count("*").alias("candidate_records"),
        F.count_if(F.col("status") == "QC_PASSED").alias("published_records"),
        F.count_if(F.col("status") == "FAILED_PENDING_REVIEW").alias("failed_records"),
        F.count_if(F.col("status").isin("FIXED_EXCLUDED", "RECORD_EXCLUDED")).alias("excluded_records"),
        F.count_distinct(F.when(F.col("status") == "QC_PASSED", F.col("shard_no"))).alias("committed_shards"),
    ).crossJoin(F.broadcast(shards))  # one row each


def export_constants(spark: SparkSession, root: str) -> None:
    """Channel and enum dimensions beside the release, as JSON."""
    m.channel_dimension(spark).coalesce(1).write.mode("overwrite").json(f"{root}/config/channels")
    m.enum_dimension(spark).coalesce(1).write.mode("overwrite").json(f"{root}/config/enums")
    s = m.RuleSpec()
    values = [("line_threshold", s.line_threshold), ("high_frequency_threshold", s.high_frequency_threshold),
              ("saturation_threshold", s.saturation_threshold), ("spo2_min_fraction", s.spo2_min_fraction),
              ("psd_segment", float(s.psd_segment)), ("psd_overlap", float(s.psd_overlap)),
              ("flat_code_span", s.flat_code_span)]
    values += [(f"amplitude_limit.{k}", v) for k, v in s.amplitude_limit.items()]
    values += [(f"flat_std.{k}", v) for k, v in s.flat_std.items()]
    m.inline_table(spark, values, ("name", "value")).coalesce(1).write.mode("overwrite").json(f"{root}/config/rules")


def incompatible_batches(rows: DataFrame, batch: str, shared: Sequence[str],
                         optional: Sequence[str] = ()) -> DataFrame:
    """Batches whose members disagree on shared metadata, or only partly have an optional value."""
    aggs = [(F.min(c).eqNullSafe(F.max(c)) & (F.count(c).isin(0) | (F.count(c) == F.count("*")))).alias(c) for c in shared]
    aggs += [((F.count(c) == 0) | (F.count(c) == F.count("*"))).alias(c) for c in optional]
    wide = rows.groupBy(batch).agg(*aggs)
    return problems(wide, [batch], {c: F.col(c) for c in (*shared, *optional)})


def window_violations(windows: DataFrame, records: DataFrame) -> DataFrame:
    """Windows that leave their recording."""
    r = records.select("recording_id", F.col("n_epochs").alias("_n"))
    out = windows.join(r, "recording_id", "left")
    bad = (F.col("start_epoch") < 0) | (F.col("n_epochs") <= 0) | (F.col("start_epoch") + F.col("n_epochs") > F.col("_n"))
    return out.where(F.coalesce(bad, F.lit(True))).drop("_n")


def batch_contract_violations(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row-level contract of an adapted batch in long form."""
    expected = F.col("channel_available") & F.col("coverage_valid") & F.col("processing_valid") & F.col("artifact_valid")
    live = F.col("data_valid") & F.col("channel_mask")
    return problems(rows, keys, {
        "valid": F.col("valid") == expected,
        "channel_mask": F.col("channel_available") | ~F.col("channel_mask"),
        "data_valid": F.col("data_valid") == (F.col("valid") & F.col("epoch_mask")),
        "position": ~F.col("epoch_mask") | (F.col("epoch_in_record") >= 0),
        "rate": F.col("sample_rate_hz") > 0,
        "finite": ~live | F.forall("samples", lambda x: finite(x.cast("double")))})
