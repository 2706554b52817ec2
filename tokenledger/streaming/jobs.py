"""Streaming jobs: enrichment, the live coach with keyed state, daily usage, dedup, and the usage-log sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger import adapters as T
from tokenledger import settings as S
from tokenledger import staging
from tokenledger.functions.text import token_estimate
from tokenledger.operators import calibration, carry, duplicates, pricing, rules
from tokenledger.operators.budget import metered, shown, with_projection
from tokenledger.operators.turns import dedup_turns
from tokenledger.plans import checks
from tokenledger.plans.queries import COACH
from tokenledger.settings import DEFAULTS, Settings
from tokenledger.sources import readers, sinks
from tokenledger.staging import Versions, shared_folder


def read_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """The Parquet files of a folder (or a single one) as a stream, so many a batch."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(files)).parquet(path)


def enrich(requests: DataFrame, s: Settings = DEFAULTS, multipliers: DataFrame | None = None) -> DataFrame:
    """requests (prompt, model, context_tokens, ref_count, ref_ids) with projected output and dollars, a cheaper model, and the rules that need no state.

    multipliers: (model, multiplier) learnt from history, a static table that each batch is joined with.
    """
    requests, own = pricing.with_learnt(requests, multipliers)
    m = pricing.output_multiplier(F.col("model"), s, own)
    out = requests.withColumn("projected", pricing.projected_output(F.col("context_tokens"), m)).drop("learnt")
    p, c = pricing.price_of(F.col("model"), s), pricing.cheaper_of(F.col("model"), F.col("context_tokens"), F.col("projected"), s)
    found = F.array(*[F.when(v, F.lit(k)) for k, v in rules.rule_columns(requests.sparkSession, s).items()])
    return out.withColumns({"projected_usd": pricing.usd(F.col("context_tokens") * p["p_in"] + F.col("projected") * p["p_out"]), "cheaper": c["model"], "findings": F.filter(found, lambda x: x.isNotNull())})


def stream_daily(turns: DataFrame, delay: str = "31 days") -> DataFrame:
    """Turns and tokens per UTC day and model; rows later than the delay are dropped."""
    return turns.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "model").agg(F.count("*").alias("turns"), F.sum("input_tokens").alias("input_tokens")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "model", "turns", "input_tokens")


def stream_dedup(turns: DataFrame, delay: str = "1 day") -> DataFrame:
    """A turn of each response id within the delay, in Spark's own state: for dated turns with ids, whichever of a batch's equals stays."""
    return turns.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["response_id"])


class FirstTurns:
    """dedup_turns over a stream: of a response id the first batch's turn stays, within a batch the first in dedup_turns' order; turns without an id all stay.

    Ids that came are kept as versions by batch; those whose last day lies more
    than idle days before the latest are forgotten when a full version is written.
    """

    def __init__(self, path: str, idle: int | None = None, every: int = 16):
        self.seen, self.idle = Versions(f"{path}/seen", ["response_id"], "response_id string, day date", every), idle

    def told(self, batch: DataFrame, n: int) -> DataFrame:
        batch = staging.save(batch, "turns")
        held = self.seen.before(batch.sparkSession, n, batch.where("response_id <> ''").select("response_id"))
        out = staging.save(dedup_turns(batch.join(held.select("response_id"), "response_id", "left_anti").select(*batch.columns)), "first-turns")
        ids = out.where("response_id <> ''").select("response_id", F.to_date("ts").alias("day"))
        last = ids.agg(F.max("day")).first()[0]
        keep = None if self.idle is None or last is None else F.coalesce(F.col("day") >= F.date_sub(F.lit(last), self.idle), F.lit(True))
        self.seen.put(ids, n, keep)
        return out


class Coach:
    """The live coach on prompts: what a request is told rests on its session and on all that was asked before, kept as versions by batch.

    Word sets of sessions, contexts of sessions and the index of past prompts
    are tables below path. A batch reads what earlier batches wrote of its own
    sessions, joins (the prefix-filter join of the batch operators), and writes
    what it changed under its number: it may run again, and the stream may stop
    and start between any two. Sets whose session asked nothing for `idle`
    (in the unit of asked_at) go when a full version is written.
    """

    def __init__(self, path: str, s: Settings = DEFAULTS, session: str = "string", idle: int | None = None, every: int = 16, refresh: int = 25):
        self.s, self.idle, self.path = s, idle, path
        self.sets = Versions(f"{path}/sets", ["session_id", "id"], f"session_id {session}, id bigint, first bigint, words array<string>, asked_at bigint", every)
        self.contexts = Versions(f"{path}/contexts", ["session_id"], f"session_id {session}, turns bigint, context bigint", every)
        self.index = Versions(f"{path}/index", ["norm"], "norm string, id bigint, words array<string>, first bigint, latest bigint, project string", refresh)

    def _repeats(self, batch: DataFrame, n: int, below: bool = False) -> DataFrame:
        """(session_id, seq, similarity) as session_duplicates has it for all prompts so far, or with below as nearest_earlier has it; the batch's new sets are kept."""
        spark = batch.sparkSession
        earlier = staging.save(self.sets.before(spark, n, batch.select("session_id")), "earlier-sets")
        found = staging.save(duplicates.nearest_earlier(batch, earlier) if below else duplicates.session_duplicates(batch, self.s, earlier), "repeats")
        _, sets = duplicates.prompt_sets(batch)
        asked = batch.groupBy("session_id").agg(F.max("asked_at").alias("asked_at"))
        # sets of sessions that asked again are as young as their session
        sets = sets.unionByName(earlier.select(*sets.columns)).groupBy("session_id", "id").agg(F.min("first").alias("first"), F.first("words").alias("words")).join(asked, "session_id", "left")
        now = batch.agg(F.max("asked_at")).first()[0]
        self.sets.put(sets, n, None if self.idle is None or now is None else F.coalesce(F.col("asked_at") >= now - self.idle, F.lit(True)))
        return found

    def _often(self, n: int) -> str:
        return f"{self.path}/often/full={n // self.index.every * self.index.every}"

    def _past(self, batch: DataFrame, n: int) -> DataFrame:
        """history_duplicates for the batch's prompts among all prompts so far; the index is ranked anew every refresh batches."""
        spark = batch.sparkSession
        own = duplicates.build_prompt_index(batch, None).withColumn("id", F.xxhash64("norm"))
        own = staging.save(own, "own-norms")  # joined by their ids, as everywhere: texts stay where they are
        often = spark.read.schema("word string, df bigint").parquet(self._often(n - 1)) if n else duplicates.word_counts(own)
        before = self.index.before(spark, n)
        old = before.join(own.select("id"), "id", "left_semi").select("id", *[F.col(c).alias(f"old_{c}") for c in ("first", "latest", "project")])
        both = duplicates.rarest_first(own, often).join(old, "id", "left")
        project = F.when(F.col("old_latest") > F.col("latest"), F.col("old_project")).otherwise(F.col("project"))
        changed = staging.save(both.select("norm", "id", "words", F.least("first", "old_first").alias("first"), F.greatest("latest", "old_latest").alias("latest"), project.alias("project")), "norms")
        index = staging.save(before.join(changed.select("id"), "id", "left_anti").unionByName(changed), "all-norms")  # read by five joins
        found = staging.save(duplicates.history_duplicates(batch, index, self.s, indexed=True), "past")

        def ranked(rows: DataFrame) -> DataFrame:
            rows = staging.save(rows, "index")
            duplicates.word_counts(rows).write.mode("overwrite").parquet(self._often(n))
            return duplicates.rarest_first(rows, spark.read.parquet(self._often(n)))

        self.index.put(changed, n, remake=ranked)
        return found

    def told(self, batch: DataFrame, n: int, findings: bool = True, threshold: DataFrame | None = None, multipliers: DataFrame | None = None, below: bool = False) -> DataFrame:
        """The n-th batch of prompts (as evaluate_rules takes them, with asked_at) with similarity, growth, turn_index, ran (not skipped as a duplicate), and findings; without these no history is kept.

        below: similarities under the threshold are told as well, 0 for a prompt that is like no earlier one.
        """
        spark = batch.sparkSession
        batch = staging.save(batch, "asked")
        nearest = self._repeats(batch, n, below)
        repeats = nearest.where(F.col("similarity") >= self.s.dup_threshold)
        held = staging.save(self.contexts.before(spark, n, batch.select("session_id")), "contexts")
        rows = rules.evaluate_rules(batch, repeats, self._past(batch, n), self.s, threshold, multipliers, held) if findings else rules.with_growth(batch, repeats, self.s, held)
        if below:
            rows = rows.drop("similarity").join(nearest.hint("merge"), ["session_id", "seq"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
        rows = carry.place(rows, ["session_id"], "seq", "turn_index").join(held.select("session_id", "turns"), "session_id", "left")
        rows = rows.withColumn("turn_index", F.col("turn_index") + F.coalesce("turns", F.lit(0))).drop("turns").withColumn("ran", ~(F.col("duplicate") & F.lit(self.s.block_duplicates)))
        rows = staging.save(rows, "told")
        last = rows.groupBy("session_id").agg(F.max("turn_index").alias("turns"), F.max_by("context_tokens", F.when(F.col("ran"), F.col("seq"))).alias("now"))
        self.contexts.put(last.join(held.select("session_id", "context"), "session_id", "left").select("session_id", "turns", F.coalesce("now", "context").alias("context")), n)
        return rows


class BudgetMeter:
    """Budgets over a stream of turns and resets: what each session and each owner's day has used, kept as versions by batch.

    All sessions of an owner share its day, whichever batch they come in. A
    reset (kind) starts its session's budget anew, from the rows after it on.
    """

    def __init__(self, path: str, s: Settings = DEFAULTS, owner: str = "session_id", daily_owner: str = "project", every: int = 16):
        self.s, self.owner, self.daily_owner = s, owner, daily_owner
        self.sessions = Versions(f"{path}/sessions", [owner], f"{owner} string, segment bigint, used bigint, turns bigint", every)
        self.days = Versions(f"{path}/days", [daily_owner, "day"], f"{daily_owner} string, day string, used bigint", every)

    def told(self, batch: DataFrame, n: int) -> DataFrame:
        """The n-th batch (seq, kind turn or reset, owners, day, projected, spent) with segment, turn_index, session_used, day_used, level, budget (and blocked); resets are left out."""
        spark, owner, key = batch.sparkSession, self.owner, [self.daily_owner, "day"]
        zero = F.lit(0).cast("long")
        held = self.sessions.before(spark, n, batch.select(owner)).select(owner, F.col("segment").alias("old_segment"), F.col("used").alias("old_used"), F.col("turns").alias("old_turns"))
        days = self.days.before(spark, n, batch.select(*key)).withColumnRenamed("used", "day_base")
        reset = (F.col("kind") == "reset").cast("long")
        rows = carry.sums_before(batch, [owner], "seq", {"segment": reset, "turn_index": 1 - reset}).join(held, owner, "left").join(days, key, "left")
        old = F.coalesce("old_segment", zero)
        rows = rows.withColumns({"segment": old + F.col("segment") + reset, "turn_index": F.coalesce("old_turns", zero) + F.col("turn_index") + 1 - reset, "day_base": F.coalesce("day_base", zero)})
        rows = rows.withColumn("session_base", F.when(F.col("segment") == old, F.coalesce("old_used", zero)).otherwise(zero)).withColumns({c: F.when(F.col("kind") == "reset", zero).otherwise(F.col(c)) for c in ("projected", "spent")})
        rows = staging.save(rows.drop("old_used", "old_turns", "old_segment"), "metered")
        # a reset projects and spends nothing, but one that finds its day used up would count as stopped
        turns = staging.save(metered(rows.where("kind <> 'reset'"), self.s, [owner, "segment"], key), "told")
        sums = turns.groupBy(owner, "segment").agg(F.max("turn_index").alias("turns"), (F.sum("spent") + F.max("session_base")).alias("used"))
        sums = sums.unionByName(rows.where("kind = 'reset'").select(owner, "segment", F.col("turn_index").alias("turns"), zero.alias("used")))
        sums = sums.groupBy(owner, "segment").agg(F.max("turns").alias("turns"), F.max("used").alias("used"))
        last = sums.groupBy(owner).agg(F.max(F.struct("segment", "used", "turns")).alias("x"), F.max("turns").alias("turns"))
        self.sessions.put(last.select(owner, "x.segment", "x.used", "turns"), n)
        self.days.put(turns.groupBy(*key).agg((F.sum("spent") + F.max("day_base")).alias("used")), n)
        return shown(turns, self.s).drop("session_base", "day_base")


def refreshed(load: Callable[[SparkSession], DataFrame], every: int = 25) -> Callable[[SparkSession, int], DataFrame]:
    """load's table for a batch's number: read at the first batch and again after every so many, and kept between."""
    held: list[DataFrame] = []

    def table(spark: SparkSession, number: int) -> DataFrame:
        if not held or number % every == 0:
            for old in held:
                old.unpersist()
            held[:] = [load(spark).persist()]
        return held[0]

    return table


def run_to_table(df: DataFrame, mode: str = "append", keys: list[str] | None = None, each: Callable[[DataFrame, int], DataFrame] | None = None, path: str | None = None) -> DataFrame:
    """Run a streaming job over what is there into files of the shared folder, and read them.

    A batch that is run again takes its own place. In update mode, of the
    versions of a row (keys) the last batch's counts. each changes a batch
    before it is written. With a path the job goes on where a former run ended.
    What batches and their state join grows with the input, and its files tell
    less than its rows take in the driver: in the stream's own session only
    tables marked for it are broadcast.
    """
    spark = df.sparkSession
    path = path or shared_folder(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            batch.sparkSession.conf.set(name, "-1")
        out = each(batch, number) if each else batch
        out.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not staging.exists(spark, f"{path}/out"):
        return spark.createDataFrame([], df.schema)
    done = spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out/batch=*")
    if keys:
        rest = [c for c in df.columns if c not in keys]
        return done.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*[c if c in keys else F.col(f"last.{c}").alias(c) for c in df.columns])
    return done.drop("batch")


#: Rows of a batch for which it has a file more, so that its tasks grow with it.
FILE_ROWS = 250_000


def in_batches(df: DataFrame, order: str, batches: int = 5, files: int = 2, align: int = 1) -> DataFrame:
    """df as a stream of so many batches of near sizes in the order of a column, each in files of its own (files at least) and in no order within; they end before multiples of align."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, "batches")
    df = staging.save(df, "unbatched")  # made once, not for each batch
    files = max(files, df.count() // (batches * FILE_ROWS))
    cuts = df.selectExpr(f"percentile_approx({order}, array({', '.join(str(i / batches) for i in range(1, batches))})) AS c").first()["c"] or []
    cuts = [c // align * align - 1 if align > 1 else c for c in cuts]
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = df if low is None else df.where(F.col(order) > low)
        part = part if high is None else part.where(F.col(order) <= high)
        part.repartition(files, F.xxhash64(F.lit(7), F.col(order))).write.mode("append").parquet(path)
    staging.discard(df)
    return read_stream(spark, path, files)


# --- queries -------------------------------------------------------------------------
def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.turns_of(read_stream(spark, f"{sf_dir}/events.parquet")).withColumn("ts", F.col("ts").cast("timestamp"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_rows(read_stream(spark, f"{sf_dir}/conversations.parquet"))


def request_rows(conversations: DataFrame) -> DataFrame:
    said = conversations.where("role = 'user'")
    model = "CASE conv_id % 4 WHEN 0 THEN 'claude-opus-4.8' WHEN 1 THEN 'gpt-4o-mini' WHEN 2 THEN 'o3' ELSE 'in-house-7b' END AS model"
    return said.selectExpr("concat('c', conv_id) AS session_id", "cast(turn AS bigint) AS seq", "text AS prompt", model, "turn % 9 AS ref_count", "array('file:a') AS ref_ids").withColumn("context_tokens", token_estimate(F.col("prompt")))


def daily_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_to_table(stream_daily(_turns(spark, sf_dir)), "update", ["day", "model"])


def dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of turns; none parts a response from its repetition, so the result is that of all turns at once."""
    path = shared_folder(spark, "first-turns")
    rows = T.turns(spark, sf_dir).select("source", "project", "session_id", "seq", "response_id", "model", "ts", "input_tokens", "output_tokens")
    return run_to_table(in_batches(rows, "seq", 3, align=20), each=FirstTurns(f"{path}/state").told, path=path)


def enrich_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    threshold = refreshed(lambda x: calibration.snowball_threshold(T.usage_log(x, sf_dir)))
    large = lambda batch, n: batch.join(F.broadcast(threshold(batch.sparkSession, n)), how="cross").withColumn("large", F.col("context_tokens") > F.col("threshold")).drop("threshold")
    out = enrich(_requests(spark, sf_dir)).select("session_id", "seq", "projected", "projected_usd", "cheaper", F.array_join("findings", ",").alias("findings"), "context_tokens")
    return run_to_table(out, each=large).drop("context_tokens")


def session_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = request_rows(T.table(spark, sf_dir, "conversations")).withColumn("asked_at", F.col("seq"))
    path = shared_folder(spark, "sessions")
    live = Coach(f"{path}/state")
    return run_to_table(in_batches(said, "seq", 3), each=lambda batch, n: live.told(batch, n, findings=False, below=True).select("session_id", "seq", "turn_index", "similarity", "growth", "ran"), path=path)


def findings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules as the coach finds them live, over three batches of prompts in the order in which they were asked."""
    path = shared_folder(spark, "findings")
    live = Coach(f"{path}/state", COACH, session="bigint", refresh=2)
    return run_to_table(in_batches(T.prompts(spark, sf_dir), "asked_at", 3), each=lambda batch, n: live.told(batch, n).select("session_id", "seq", F.array_join("findings.rule", ",").alias("findings")), path=path)


def budget_rows(turns: DataFrame) -> DataFrame:
    """Turns with resets: each twenty-ninth resets its session before it."""
    rows = with_projection(turns).withColumn("day", F.coalesce(F.to_date("ts").cast("string"), F.lit("")))
    rows = rows.withColumn("kind", F.explode(F.when(F.col("seq") % 29 == 0, F.array(F.lit("reset"), F.lit("turn"))).otherwise(F.array(F.lit("turn")))))
    return rows.select("session_id", "project", "day", "kind", (F.col("seq") * 2 + (F.col("kind") == "turn").cast("long")).alias("seq"), "projected", "spent")


def budget_query(spark: SparkSession, sf_dir: str, s: Settings = DEFAULTS) -> DataFrame:
    """Turns and resets in five batches: the sessions' and the owners' days' totals go on from batch to batch."""
    path = shared_folder(spark, "budgets")
    meter = BudgetMeter(f"{path}/state", s)
    out = run_to_table(in_batches(budget_rows(T.turns(spark, sf_dir, monthly=True)), "seq"), each=meter.told, path=path)
    return out.select("session_id", F.floor(F.col("seq") / 2).alias("seq"), "turn_index", "session_used", "day_used", "level", *(["blocked"] if s.hard_block else []))


def sink_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage log as a sink: each batch writes its records in a place of its own, whether it runs once or again; then they are read back."""
    path = shared_folder(spark, "stream-log")
    rows = pricing.list_cost(_turns(spark, sf_dir)).withColumn("turn_index", F.col("seq"))
    query = rows.writeStream.foreachBatch(lambda batch, n: sinks.write_usage_log(batch, f"{path}/log", "ledger", n)).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return readers.read_usage_log(spark, f"{path}/log", "ledger").select("session_id", F.col("turn_index").alias("seq"), "model", "input_tokens", "output_tokens", "cost_usd")


QUERIES = {"stream_daily": daily_query, "stream_dedup": dedup_query, "stream_enrich": enrich_query, "stream_session_state": session_query, "stream_findings": findings_query, "stream_budget": budget_query, "stream_sink": sink_query}

_D = DEFAULTS
_SAID = "SELECT 'c' || conv_id AS session_id, turn AS seq, text AS prompt, CASE conv_id % 4 WHEN 0 THEN 'claude-opus-4.8' WHEN 1 THEN 'gpt-4o-mini' WHEN 2 THEN 'o3' ELSE 'in-house-7b' END AS model, cast(ceil(length(text) / 4) AS bigint) AS c FROM conversations WHERE role = 'user'"
_WORDS = checks.WORDS.format("lower(prompt)", 1)
ORACLES = {
    "stream_daily": checks.statement("turns", "SELECT cast(cast(ts AS date) AS varchar) AS day, model, count(*) AS turns, cast(sum(input_tokens) AS bigint) AS input_tokens FROM turns WHERE ts IS NOT NULL GROUP BY ALL"),
    "stream_dedup": checks.check_sql("turns_dedup"),
    "stream_enrich": checks.statement("book_of usage_log p90", f"""WITH p AS (SELECT x.*, b.price_key, {checks.PROJECT.format('c', checks.REASON.format('x.model'))} AS projected, p_in, p_out FROM ({_SAID}) x JOIN book_of b ON x.model = b.model),
      asked_p AS (SELECT DISTINCT model, c AS tin, projected AS tout, c * p_in + projected * p_out AS now FROM p), g AS ({checks.suggestions('asked_p')})
      SELECT session_id, seq, projected, cast(c * p_in + projected * p_out AS double) / 1e13 AS projected_usd, pick AS cheaper, c > CASE WHEN (SELECT count(*) FROM usage_log) >= {_D.min_turns} THEN coalesce(p90, {_D.snowball_tokens}) ELSE {_D.snowball_tokens} END AS large,
        concat_ws(',', CASE WHEN seq % 9 > {_D.max_refs} THEN 'many_references' END, CASE WHEN regexp_matches(prompt, '^{checks.SPACES}*(```|[A-Za-z]:\\\\|/)') OR (length(prompt) > 600 AND NOT regexp_matches(prompt, '(?i)^{checks.SPACES}*(?:{S.STABLE_LEAD})')) THEN 'cache_order' END,
          CASE WHEN NOT {checks.hint(_D.cheap_hints, 'p.model')} AND ({checks.word('prompt', S.TRIVIAL)} OR NOT {checks.word('prompt', S.HARD)}) AND length(prompt) < 600 AND pick IS NOT NULL THEN 'overkill' END,
          CASE WHEN {checks.word('prompt', S.GENERATIVE)} AND NOT {checks.word('prompt', S.BRIEF)} AND length(prompt) < 2000 THEN 'no_cap' END, CASE WHEN {checks.hint(_D.reasoning_hints, 'p.model')} THEN 'reasoning' END, CASE WHEN price_key IS NULL THEN 'unknown_price' END) AS findings
      FROM p LEFT JOIN g ON p.model = g.model AND c = tin AND projected = tout, p90"""),
    "stream_session_state": f"""WITH p AS (SELECT *, {_WORDS} AS words FROM ({_SAID})), b AS (SELECT a.session_id, a.seq, max({checks.JACCARD.format('a.words', 'x.words')}) AS similarity FROM p a JOIN p x ON a.session_id = x.session_id AND x.seq < a.seq GROUP BY ALL),
      r AS (SELECT p.session_id, p.seq, c, coalesce(similarity, 0.0) AS similarity, coalesce(similarity, 0) < {_D.dup_threshold} AS ran FROM p LEFT JOIN b ON p.session_id = b.session_id AND p.seq = b.seq)
      SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS turn_index, similarity, c - last_value(CASE WHEN ran THEN c END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS growth, ran FROM r""",
    "stream_findings": checks.check_sql("guardrail_findings"),
    "stream_budget": checks.statement("spent", f"""SELECT session_id, seq, turn_index, cast(su AS bigint) AS session_used, cast(du AS bigint) AS day_used, {checks.level('(su + projected)', '(du + projected)').split(', CASE')[0]} FROM (
      SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS turn_index, {checks.BEFORE.format('session_id, segment')} AS su, {checks.BEFORE.format('project, d')} AS du FROM (
        SELECT *, sum(CASE WHEN seq % 29 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS segment FROM spent))"""),
    "stream_sink": checks.statement("turns book_of", "SELECT session_id, seq, t.model, input_tokens, output_tokens, floor(cast(input_tokens * p_in + output_tokens * p_out AS double) / 1e13 * 1e6 + 0.5) / 1e6 AS cost_usd FROM turns t JOIN book_of b ON t.model = b.model"),
}
