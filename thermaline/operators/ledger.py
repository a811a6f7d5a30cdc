"""Queries on append-only logs. Order is the column line, never the order of reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import broken


def win_streak(cycles: DataFrame) -> DataFrame:
    """cycles: cell, cycle, line, submission, result. The newest submission of a cell and its unbroken wins up to now."""
    newest = Window.partitionBy("cell").orderBy(F.desc("cycle"), F.desc("line"))
    got = cycles.withColumn("now", F.first("submission").over(newest))
    got = got.withColumn("breaks", F.sum(F.when((F.col("submission") == F.col("now")) & (F.col("result") == "win"), 0).otherwise(1)).over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    return got.groupBy("cell").agg(F.first("now").alias("submission"), F.count(F.when(F.col("breaks") == 0, 1)).alias("streak"))


def latest_claim(claims: DataFrame) -> DataFrame:
    """The last claim of a cell by ts, then by line."""
    return claims.withColumn("_k", F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("ts"), F.desc("line")))).where("_k = 1").drop("_k")


def active_tenures(events: DataFrame) -> DataFrame:
    """events: cell, line, event, author, start_month. The last start of a cell, unless a later end names its month."""
    start = events.where("event = 'tenure_start'").groupBy("cell").agg(F.max_by(F.struct("line", "author", "start_month"), "line").alias("s")).select("cell", "s.*")
    ends = events.where("event = 'tenure_end'").select(F.col("cell").alias("_cell"), F.col("line").alias("_line"), F.col("start_month").alias("_month"))
    return start.join(ends, (F.col("cell") == F.col("_cell")) & (F.col("_line") > F.col("line")) & F.col("start_month").eqNullSafe(F.col("_month")), "left_anti")


def holder(events: DataFrame) -> DataFrame:
    """The author who holds a cell: the last event decides, and any end clears it."""
    last = events.where("event IN ('tenure_start', 'tenure_end')").groupBy("cell").agg(F.max_by(F.struct("event", "author"), "line").alias("e"))
    return last.select("cell", F.when(F.col("e.event") == "tenure_start", F.col("e.author")).alias("holder"))


def promotions(candidates: DataFrame, holders: DataFrame, streak: int = 2) -> DataFrame:
    """candidates: cell, author, submission, result, streak; holders: cell, author, submission, one a cell. Lines to append.

    A win that makes the streak ends the tenure of another author and starts one, unless the submission holds the cell.
    """
    held = holders.select("cell", F.col("author").alias("_author"), F.col("submission").alias("_submission"))
    got = candidates.where((F.col("result") == "win") & (F.col("streak") >= streak)).join(held, "cell", "left")
    line = lambda event, author, submission: F.struct(F.lit(event).alias("event"), F.col(author).alias("author"), F.col(submission).alias("submission"))
    end = F.when(F.col("_author") != F.col("author"), line("tenure_end", "_author", "_submission"))
    start = F.when(~F.col("_submission").eqNullSafe(F.col("submission")), line("tenure_start", "author", "submission"))
    return got.select("cell", F.inline(F.array_compact(F.array(end, start))))


def leaderboard(events: DataFrame) -> DataFrame:
    """Starts by author; rank by count, then by first appearance."""
    got = events.where("event = 'tenure_start'").groupBy("author").agg(F.count("*").alias("n"), F.min("line").alias("first"))
    return got.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "first"))).drop("first")  # a row for each author


def recent(lines: DataFrame, n: int = 3) -> DataFrame:
    """Lines of the n most recent distinct cycles."""
    return lines.join(F.broadcast(lines.select("cycle").distinct().orderBy(F.desc("cycle")).limit(n)), "cycle", "left_semi")


def append_only(base: DataFrame, head: DataFrame) -> DataFrame:
    """Both: line, text, id (NULL: no uniqueness). Violations: edited or deleted lines, identities that occur again."""
    b, h = base.select("line", F.col("text").alias("was")), head.select("line", F.col("text").alias("now"))
    changed = b.join(h, "line", "full_outer").withColumn("violation", F.when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "edited")).where("violation IS NOT NULL AND was IS NOT NULL").select("line", "violation")
    again = F.row_number().over(Window.partitionBy("id").orderBy("line"))  # rows of one identity are few: lines without one aren't here
    double = head.where("id IS NOT NULL").withColumn("again", again).where("again > 1").select("line", F.lit("duplicate").alias("violation"))
    return changed.unionByName(double.join(changed, "line", "left_anti"))


def new_values(now: DataFrame, before: DataFrame) -> DataFrame:
    """Set difference of one-column frames."""
    return now.distinct().subtract(before.distinct())


# Patterns, words and required fields of the three logs.
ID, MONTH, SHA = r"^\d{4}-\d{2}-\d{3}$", r"^\d{4}-\d{2}$", r"^[0-9a-f]{64}$"
TRACKS, RUNGS, STATUSES, EVENTS, TARGETS = ("serving-ready", "research"), ("A", "B", "C"), ("win", "loss", "insufficient_n"), ("tenure_start", "tenure_end"), ("tmax", "tmin")
CELL = "struct<model_version:string,band_key:string,target:string,zone:string>"
SCHEMAS = {
    "submissions": "ts string, submission_id string, author_github string, track string, rung string, model_version string, band_key string, snapshot_version string, manifest_sha256 string, claimed_report_sha256 string, reproduced boolean, pr string, runner_commit string",
    "cycles": f"ts string, cycle string, eval_month string, submission_id string, author_github string, cell {CELL}, n_forward bigint, n_stations bigint, rmse_grid_c double, status string, snapshot_version string, runner_commit string, package_version string",
    "credit": f"ts string, event string, cell {CELL}, author_github string, submission_id string, start_month string, end_month string, superseded_by string",
}
NULLABLE = {"submissions": ("runner_commit",), "cycles": ("rmse_grid_c", "runner_commit"), "credit": ("submission_id", "start_month", "end_month", "superseded_by")}


def violations(lines: DataFrame, kind: str) -> DataFrame:
    """lines: line, and the columns of SCHEMAS[kind]. line and violation, one row for each rule that a line breaks: a
    required field that is null, a text of the wrong form, a word that isn't allowed, and by event the fields of a start
    (open end) or an end (a month)."""
    if kind not in SCHEMAS:
        raise ValueError(f"unknown log {kind}")
    fields = [f.split(" ")[0] for f in SCHEMAS[kind].replace(CELL, "struct").split(", ")]
    c = F.col
    bad = [(c(f).isNull(), f) for f in fields if f not in NULLABLE[kind]]
    form = lambda f, pattern: (c(f).isNotNull() & ~c(f).rlike(pattern), f"form of {f}")
    word = lambda f, words: (c(f).isNotNull() & ~c(f).isin(*words), f"word in {f}")
    if kind == "submissions":
        bad += [form("submission_id", ID), form("manifest_sha256", SHA), form("claimed_report_sha256", SHA), word("track", TRACKS), word("rung", RUNGS)]
    elif kind == "cycles":
        bad += [form("submission_id", ID), form("cycle", MONTH), form("eval_month", MONTH), word("status", STATUSES)]
    else:
        start, end = c("event") == "tenure_start", c("event") == "tenure_end"
        bad += [word("event", EVENTS), (start & c("submission_id").isNull(), "submission_id"), (start & ~F.coalesce(c("submission_id"), F.lit("0000-00-000")).rlike(ID), "form of submission_id")]
        bad += [((start | end) & ~F.coalesce(c("start_month"), F.lit("")).rlike(MONTH), "form of start_month"), (start & c("end_month").isNotNull(), "end_month"), (end & ~F.coalesce(c("end_month"), F.lit("")).rlike(MONTH), "form of end_month")]
    if "cell" in fields:
        bad += [(c("cell").isNotNull() & c(f"cell.{x}").isNull(), f"cell.{x}") for x in ("model_version", "band_key", "target", "zone")] + [word("cell.target", TARGETS)]
    return broken(lines, ["line"], bad)


def identity(kind: str) -> Column:
    """What must not occur twice in a log: the submission, or a cycle's cell and submission; nothing for credit. A missing
    part is the text null."""
    parts = {"submissions": ["submission_id"], "cycles": ["cycle", "cell.model_version", "cell.band_key", "cell.target", "cell.zone", "submission_id"], "credit": []}[kind]
    return F.to_json(F.array(*[F.coalesce(F.col(x), F.lit("null")) for x in parts])) if parts else F.lit(None).cast("string")


def append_only_logs(base: DataFrame, head: DataFrame) -> DataFrame:
    """Both: kind, line, text, id, as one frame for all logs. Violations of each log, with its kind."""
    number = lambda df: df.withColumn("line", F.struct("kind", "line")).withColumn("id", F.when(F.col("id").isNotNull(), F.concat_ws("/", "kind", "id")))
    return append_only(number(base), number(head)).select("line.kind", "line.line", "violation")


def unused(ids: DataFrame, submissions: DataFrame) -> DataFrame:
    """ids (submission_id) with used: whether the log has it already."""
    have = submissions.select(F.col("submission_id").alias("_id")).distinct()
    return ids.join(have, ids["submission_id"] == have["_id"], "left").select(*ids.columns, F.col("_id").isNotNull().alias("used"))


def _cell(df: DataFrame) -> Column:
    return F.struct(*[F.col(x) for x in ("model_version", "band_key", "target", "zone")]).alias("cell")


def cycle_lines(scored: DataFrame, cycle: str, ts: str, snapshot: str, commit: str | None, version: str) -> DataFrame:
    """scored: submission_id, author_github, the cell's four columns and metrics. A JSON text for each scored cell."""
    metrics = [c for c in scored.columns if c not in ("submission_id", "author_github", "model_version", "band_key", "target", "zone")]
    line = F.struct(
        F.lit(ts).alias("ts"), F.lit(cycle).alias("cycle"), "submission_id", "author_github", _cell(scored), *metrics,
        F.lit(None).cast("string").alias("incumbent_submission_id"), F.lit(snapshot).alias("snapshot_version"), F.lit(commit).cast("string").alias("runner_commit"), F.lit(version).alias("package_version"),
    )
    return scored.select(F.to_json(line, {"ignoreNullFields": "false"}).alias("text"))


def tenure_lines(events: DataFrame, cycle: str, ts: str, keep: list[str] | None = None) -> DataFrame:
    """events: event, the cell's columns, author_github, submission_id, start_month (of an end), superseded_by. JSON texts, with
    the columns that are to be kept."""
    head = [F.lit(ts).alias("ts"), F.col("event"), _cell(events), F.col("author_github")]
    none = F.lit(None).cast("string")
    start = F.struct(*head, none.alias("author_name"), none.alias("orcid"), "submission_id", F.lit(cycle).alias("start_month"), none.alias("end_month"))
    end = F.struct(*head, "start_month", F.lit(cycle).alias("end_month"), "superseded_by")
    text = lambda x: F.to_json(x, {"ignoreNullFields": "false"})
    return events.select(*(keep or []), F.when(F.col("event") == "tenure_start", text(start)).otherwise(text(end)).alias("text"))


def submission_lines(manifests: DataFrame, ts: str, repo: str, commit: str | None) -> DataFrame:
    """manifests: submission_id, author_github, track, rung, model_version, band_key, snapshot_version, manifest_sha256,
    claimed_report (its bytes), status, max_abs_deviation (map), pr_number. A JSON text each."""
    line = F.struct(
        F.lit(ts).alias("ts"), "submission_id", "author_github", "track", "rung", "model_version", "band_key", "snapshot_version", "manifest_sha256", F.sha2("claimed_report", 256).alias("claimed_report_sha256"),
        (F.col("status") == "pass").alias("reproduced"), F.coalesce("max_abs_deviation", F.create_map().cast("map<string,double>")).alias("max_abs_deviation"), F.concat(F.lit(f"{repo}#"), F.col("pr_number").cast("string")).alias("pr"), F.lit(commit).cast("string").alias("runner_commit"),
    )
    return manifests.select(F.to_json(line, {"ignoreNullFields": "false"}).alias("text"))


def append_lines(texts: DataFrame, path: str, kind: str) -> None:
    """Appends JSON texts to a log of part files, unless one of them breaks a rule."""
    parsed = texts.select(F.monotonically_increasing_id().alias("line"), F.from_json("text", SCHEMAS[kind]).alias("v")).select("line", "v.*")
    wrong = violations(parsed, kind).take(5)
    if wrong:
        raise ValueError("; ".join(r.violation for r in wrong))
    texts.select("text").write.mode("append").text(path)


def forward_stations(rows: DataFrame) -> DataFrame:
    """rows: target, zone, station_id. Scored rows and distinct stations of each cell."""
    return rows.groupBy("target", "zone").agg(F.count("*").alias("n_forward"), F.countDistinct("station_id").alias("n_stations"))


def leaderboard_documents(board: DataFrame, tenures: DataFrame) -> DataFrame:
    """board: author, n, rank; tenures: cell, author, start_month. One row: the board as JSON and as a Markdown table."""
    ranked = board.agg(F.sort_array(F.collect_list(F.struct("rank", "author", "n"))).alias("b"))  # a row for each author
    held = tenures.agg(F.sort_array(F.collect_list(F.struct("cell", "author", "start_month"))).alias("t"))
    row = lambda x: F.concat(F.lit("| "), x["rank"].cast("string"), F.lit(" | "), x["author"], F.lit(" | "), x["n"].cast("string"), F.lit(" |"))
    markdown = F.concat_ws("\n", F.lit("| rank | author | starts |"), F.lit("|---|---|---|"), F.array_join(F.transform("b", row), "\n"))
    return ranked.join(held, how="cross").select(F.to_json(F.struct(F.col("b").alias("board"), F.col("t").alias("tenures"))).alias("json"), markdown.alias("markdown"))  # one row each
