"""Streams: state lasts over micro-batches and restarts, and gives what the batch fold gives."""

from tidefold.operators import execution, folds
from tidefold.plans.folds import command_log
from tidefold.sources.model import Model
from tidefold.streaming import outbox

LOG = "budget_id long, seq long, now_ms long, delta long, dedup_key string, hard_limit long, soft_limit long"
ROWS = [(1 + i % 3, i, i * 1000, 10 + i % 7, f"k{i % 25}", 200, 100) for i in range(60)]


def test_budget_stream_equals_batch_over_restarts(spark, tmp_path):
    log = f"{tmp_path}/log.parquet"
    for part in range(3):
        spark.createDataFrame(ROWS[20 * part : 20 * part + 20], LOG).coalesce(1).write.mode("append").parquet(log)
        stream = outbox.fold_stream(outbox.read_log(spark, log), "budget_id", ["now_ms", "seq"], folds.budget_step, folds.BUDGET)
        outbox.drain(stream, f"{tmp_path}/out")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out/rows").collect()))
    want = folds.fold(spark.createDataFrame(ROWS, LOG), "budget_id", ["now_ms", "seq"], folds.budget_step, folds.BUDGET)
    assert got == sorted(map(tuple, want.collect())) and len(got) == 60


def test_once_within_watermark(spark, tmp_path):
    log = f"{tmp_path}/log.parquet"
    spark.createDataFrame(ROWS, LOG).coalesce(1).write.parquet(log)
    outbox.drain(outbox.once(outbox.read_log(spark, log), "dedup_key"), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/rows").count() == 25


def test_tail_hides_best_effort(spark, tmp_path):
    log = f"{tmp_path}/log.parquet"
    spark.createDataFrame([(1, None), (2, "durable"), (3, "best_effort")], "ts_ms long, mode string").coalesce(1).write.parquet(log)
    outbox.drain(outbox.tail(outbox.read_log(spark, log), 0), f"{tmp_path}/out")
    assert sorted(r["ts_ms"] for r in spark.read.parquet(f"{tmp_path}/out/rows").collect()) == [1, 2]


def test_execution_stream_equals_batch(spark, tmp_path):
    log = f"{tmp_path}/log.parquet"
    commands = command_log(Model(spark, "/root/testdata/sf0.001")).where("execution_id < 200")
    commands.coalesce(1).write.parquet(log)
    stream = outbox.fold_stream(outbox.read_log(spark, log), "execution_id", ["seq"], execution.step, execution.RESULT)
    outbox.drain(stream, f"{tmp_path}/out")
    got = sorted(map(str, spark.read.parquet(f"{tmp_path}/out/rows").collect()))
    want = folds.fold(commands, "execution_id", ["seq"], execution.step, execution.RESULT)
    assert got == sorted(map(str, want.collect())) and got
