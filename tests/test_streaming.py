import json

import pytest
from pyspark.sql import functions as F

from lendmend.operators import encode, models, repair
from lendmend.sources.messages import application_stream, once_per_application
from lendmend.streaming import decisions, heatmap, monitoring
from workload import planted

X = ["x1", "x2", "x3"]


@pytest.fixture(scope="module")
def live(spark):
    df = planted.defaults(spark, 2000).cache()
    imputer = encode.impute_with_flags(X).fit(df)
    model = models.train_default(imputer.transform(df), imputer.output_cols, depth=3, rounds=3)
    amount = models.amount_models(
        imputer.transform(df).withColumn("disbursed_amount", 100 + F.col("x2_filled")),
        imputer.transform(df).withColumn("disbursed_amount", 100 + F.col("x2_filled")),
        imputer.output_cols, rounds=2, depth=2, learners=("forest",),
    ).best
    return decisions.Models(default=model, amount=amount, imputer=imputer)


def message(i, x1=0.5):
    return json.dumps(
        {
            "application_id": f"a{i}", "customer_id": f"c{i}", "apply_time": "2024-01-01T00:00:00Z",
            "amount": 10.0 * i, "features": {"x1": x1, "x2": -0.1 * i, "x3": 0.0} if i % 3 else {"x2": 1.0},
        }
    )


def start(spark, inbox, root, live, step=None):
    stream = once_per_application(application_stream(spark, directory=str(inbox), files_per_trigger=1))
    step = step or decisions.batch_step(
        live, decisions.write_batch_files(f"{root}/out"),
        monitoring.monitor(f"{root}/metrics", f"{root}/alerts", max_default_rate=-1.0, min_rows=1),
    )
    q = decisions.run(stream, step, f"{root}/mark", every=None)
    q.awaitTermination()
    return q


def test_flow_end_to_end(spark, tmp_path, live):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for f in range(3):
        (inbox / f"{f}.json").write_text("\n".join(message(i) for i in range(f * 4, f * 4 + 5)) + "\n")
    q = start(spark, inbox, tmp_path, live)
    out = spark.read.parquet(f"{tmp_path}/out").cache()
    # 13 applications; two arrive twice across files and are decided once
    assert out.count() == out.select("application_id").distinct().count() == 13
    assert out.where("score IS NULL OR grade IS NULL OR suggested_amount IS NULL").isEmpty()

    batch = decisions.decide(
        application_batch(spark, inbox), live
    )
    assert decisions.check_parity(out, batch).isEmpty()

    metrics = spark.read.parquet(f"{tmp_path}/metrics")
    assert metrics.agg(F.sum("rows")).first()[0] == 13
    alerts = spark.read.parquet(f"{tmp_path}/alerts")
    assert alerts.where("measure = 'default_rate'").count() >= 3
    rows = monitoring.progress_rows(spark, q.recentProgress).collect()
    assert sum(r["rows"] for r in rows) == 15 and all(r["took_ms"] >= 0 for r in rows)

    # restart: nothing new, nothing doubled; then one more file
    start(spark, inbox, tmp_path, live)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 13
    (inbox / "9.json").write_text(message(77) + "\n" + message(3) + "\n")
    start(spark, inbox, tmp_path, live)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 14


def test_a_stranger_is_repaired_from_the_message(spark, live):
    """Numbers that neither the featured zone nor the message has are folded in; known customers keep theirs."""
    names = [f"f{i}" for i in range(6)]
    rows = planted.low_rank(spark, 300, 6, rank=2).cache()
    seen = rows.where("customer_id < 200")
    fixes = repair.fit_repair(seen, [], names, [], rank=3, check_share=0.2)
    imputer = encode.impute_with_flags(names).fit(seen)
    train = imputer.transform(seen).withColumn("loan_default", (F.col("f0_filled") > 100).cast("int"))
    model = models.train_default(train, imputer.output_cols, depth=3, rounds=3)
    flow = decisions.Models(default=model, imputer=imputer, repair=fixes, featured=seen)
    told = F.map_from_entries(F.array_compact(F.array(*[
        F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("k"), F.col(n).alias("v"))) for n in names
    ])))
    batch = rows.where("customer_id % 10 = 0").select(F.concat(F.lit("a"), "customer_id").alias("application_id"), "customer_id", told.alias("features"))
    got = {r["customer_id"]: r for r in decisions.decide(batch, flow).collect()}
    gaps = {r["customer_id"]: {n for n in names if r[n] is None} for r in rows.where("customer_id % 10 = 0").collect()}
    assert set(got) == set(gaps)
    for c, r in got.items():
        assert {x["feature"] for x in r["repairs"] or []} == (gaps[c] if len(gaps[c]) < 6 else set())
        assert {x["method"] for x in r["repairs"] or []} <= ({"als"} if c < 200 else {"fold-in"})
        assert r["score"] is not None


def application_batch(spark, inbox):
    from lendmend.sources.messages import decoded

    return decoded(spark.read.text(str(inbox))).dropDuplicates(["application_id"])


def test_every_message_has_one_outcome(spark, tmp_path, live):
    """Three malformed messages stay three and are never scored; late and repeated ones are recorded."""
    inbox = tmp_path / "in"
    inbox.mkdir()
    intake = decisions.Intake(str(tmp_path))
    step = decisions.batch_step(
        live, decisions.write_batch_files(f"{tmp_path}/out"), None, intake, monitoring.record_progress(f"{tmp_path}/progress")
    )

    def deliver(name, lines):
        (inbox / name).write_text("\n".join(lines) + "\n")
        q = decisions.run(application_stream(spark, directory=str(inbox)), step, f"{tmp_path}/mark", every=None)
        q.awaitTermination()

    deliver("1", [message(1), message(2), message(2), "{broken", "{broken", "nothing", '{"amount": 1}'])
    old = message(8).replace("2024-01-01", "2023-11-01")
    deliver("2", [old, message(1), message(5), old])
    got = {r["outcome"]: r["messages"] for r in intake.outcomes(spark).collect()}
    assert got == {"decided": 3, "malformed": 4, "late": 1, "repeated": 3}
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r["application_id"] for r in out.collect()) == ["a1", "a2", "a5"]
    assert sum(r["rows"] for r in monitoring.throughput(spark, f"{tmp_path}/progress").collect()) == 11
    late = spark.read.parquet(f"{tmp_path}/ledger").where("outcome = 'late'").first()
    assert late["reason"] and json.loads(late["payload"])["application_id"] == "a8"


def test_failed_batch_is_not_doubled(spark, tmp_path, live):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.json").write_text("\n".join(message(i) for i in range(6)) + "\n")
    write = decisions.write_batch_files(f"{tmp_path}/out")

    def dies_after_writing(batch, batch_id):
        write(decisions.decide(batch, live), batch_id)
        raise RuntimeError("lost after the write")

    with pytest.raises(Exception):
        start(spark, inbox, tmp_path, live, dies_after_writing)
    start(spark, inbox, tmp_path, live)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6


def test_relational_sink_skips_rows_already_there(spark, monkeypatch):
    stored = []
    schema = "application_id string, batch_id int"
    monkeypatch.setattr(
        "lendmend.sources.relational.jdbc_read",
        lambda s, *a, **k: s.createDataFrame(stored, schema),
    )

    def write(df, *a, **k):
        stored.extend((r["application_id"], r["batch_id"]) for r in df.collect())

    monkeypatch.setattr("lendmend.sources.relational.jdbc_write", write)
    sink = decisions.decision_sink("jdbc:x", "t")
    batch = spark.createDataFrame([("a",), ("b",)], "application_id string")
    sink(batch, 1)
    sink(batch, 1)
    sink(spark.createDataFrame([("c",)], "application_id string"), 2)
    assert sorted(stored) == [("a", 1), ("b", 1), ("c", 2)]


def test_a_jump_against_the_batches_before_alerts_once(spark, tmp_path):
    watch = monitoring.monitor(f"{tmp_path}/m", f"{tmp_path}/a", max_default_rate=2.0, trailing=3, factor=1.5)

    def batch(n, bad, amount=100.0):
        return spark.range(n).select(F.when(F.col("id") < bad, 0.9).otherwise(0.1).alias("p"), F.lit(amount).alias("suggested_amount"))

    for i, (n, bad) in enumerate([(100, 10), (100, 12), (0, 0), (100, 8), (100, 30), (100, 20)]):
        watch(batch(n, bad), i)
    alerts = lambda: sorted(map(tuple, spark.read.parquet(f"{tmp_path}/a").select("batch_id", "measure", F.round("value", 6), F.round("allowed", 6)).collect()))
    assert alerts() == [(4, "default_rate_jump", 0.3, 0.15)]  # an empty batch is no batch of the mean
    watch(batch(100, 30), 4)  # run again: neither itself nor later batches count
    assert alerts() == [(4, "default_rate_jump", 0.3, 0.15)]
    watch(batch(100, 20, amount=500.0), 6)
    assert alerts()[1:] == [(6, "mean_amount_jump", 500.0, 150.0)]
    first = monitoring.trailing_means(spark, f"{tmp_path}/m", 0, 3)
    assert first == {"default_rate": None, "mean_amount": None}


def test_heat_map_follows_event_time(spark, tmp_path):
    """A late application changes its hour's row; one beyond the delay does not; a repeated batch changes nothing."""
    schema = "apply_time timestamp, area_id int, risky boolean"
    told = lambda: {(r["h"], r["area_id"]): (r["applications"], r["bad"], r["heat"]) for r in spark.read.parquet(f"{tmp_path}/heat").select("*", F.date_format("hour", "dd HH").alias("h")).collect()}

    def deliver(rows):
        spark.createDataFrame([(f"2024-01-{t}:00", a, b) for t, a, b in rows], "t string, area_id int, risky boolean").select(
            F.col("t").cast("timestamp").alias("apply_time"), "area_id", "risky"
        ).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        heatmap.run_heat(heatmap.hourly_heat(stream, delay="3 hours"), f"{tmp_path}/heat", f"{tmp_path}/mark", every=None).awaitTermination()

    deliver([("01 08:10", 1, False), ("01 08:20", 1, False), ("01 09:05", 2, True), ("01 09:30", None, False)])
    assert told() == {("01 08", 1): (2, 0, "green"), ("01 09", 2): (1, 1, "red"), ("01 09", None): (1, 0, "green")}
    deliver([("01 08:50", 1, True), ("01 10:00", 1, False)])  # two hours behind
    assert told()["01 08", 1] == (3, 1, "red") and len(told()) == 4
    deliver([("02 10:00", 3, False)])
    deliver([("01 08:55", 1, True), ("02 09:59", 3, False)])  # a day behind, and a minute
    assert told()["01 08", 1] == (3, 1, "red") and told()["02 09", 3] == (1, 0, "green")
    before = told()
    heatmap.upsert_hours(f"{tmp_path}/heat")(spark.read.parquet(f"{tmp_path}/heat").drop("hour_key").where("area_id = 1"), 7)
    assert told() == before


def test_parity_finds_a_difference(spark):
    a = spark.createDataFrame([("a", 0.1, 600.0), ("b", 0.2, 500.0)], "application_id string, p double, score double")
    b = spark.createDataFrame([("a", 0.1, 600.0), ("c", 0.2, 500.0)], "application_id string, p double, score double")
    assert {r["application_id"] for r in decisions.check_parity(a, b).collect()} == {"b", "c"}


def test_a_batch_frees_its_shuffles(spark, tmp_path, live):
    """While a batch runs, shuffle files go with the copy they were made for; the session's setting comes back."""
    key, told = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    sink = lambda out, batch_id: told.append(out.sparkSession.conf.get(key))
    rows = spark.createDataFrame([("a1", "c1", 1.0, {"x1": 0.5})], "application_id string, customer_id string, amount double, features map<string,double>")
    before = spark.conf.get(key, "false")
    decisions.batch_step(live, sink)(rows, 0)
    assert told == ["true"] and spark.conf.get(key, "false") == before


def test_deliveries_are_compressed(spark, tmp_path):
    """Messages in gzip files are read like any others."""
    spark.createDataFrame([(message(i),) for i in range(4)], "value string").write.option("compression", "gzip").text(str(tmp_path / "in"))
    got = application_stream(spark, directory=str(tmp_path / "in")).writeStream.format("memory").queryName("zipped").trigger(availableNow=True).start()
    got.awaitTermination()
    assert spark.table("zipped").where("application_id is not null").count() == 4
