import datetime as dt

import pytest

from tokenmill.operators import telemetry as TM

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_device_peaks_from_a_table(spark):
    table = spark.createDataFrame([("H100", 989e12, 3), ("H1", 1e12, 1), ("A100", 312e12, 2), ("", 5.0, 0), (None, 6.0, 0)],
                                  "key string, flops double, priority int")
    rows = [(1, "NVIDIA H100 80GB"), (2, "A100 with H100"), (3, "T4"), (4, None), (5, ""), (1, "NVIDIA H100 80GB")]
    df = spark.createDataFrame(rows, "id long, device string")
    got = sorted((r.id, r.peak_flops) for r in TM.device_peaks(df, "device", table).collect())
    assert got == [(1, 1e12), (1, 1e12), (2, 1e12), (3, 100e12), (4, 0.0), (5, 100e12)]
    first = spark.createDataFrame([(k, f, i) for i, (k, f) in enumerate(TM.GPU_PEAK_FLOPS)], "key string, flops double, priority int")
    names = spark.createDataFrame([(n,) for n in ("Tesla T4", "A100 V100", "RTX 4090 3090", "x", None)], "device string")
    out = TM.device_peaks(names, "device", first, default=1.0).withColumn("case", TM.gpu_peak("device", default=1.0)).collect()
    assert all(r.peak_flops == r.case for r in out) and len(out) == 5
    assert TM.device_peaks(names.limit(0), "device", table).count() == 0
    many = spark.range(TM.MAX_DEVICE_KEYS + 1).selectExpr("cast(id as string) key", "1.0d flops", "0 priority")
    with pytest.raises(ValueError):
        TM.device_peaks(names, "device", many)


def test_pauses_are_not_time_and_repeated_steps_count_once(spark):
    rows = [(0, 0, b, at(10 * b)) for b in range(6)]                     # 50 s, two steps of two and a half
    rows += [(0, 0, b, at(1000 + 10 * (b - 4))) for b in range(4, 8)]    # resumed: batches 4, 5 again, 30 s
    rows += [(1, 0, b, at(2000 + 5 * b)) for b in range(4)]              # 15 s
    rows += [(0, 1, 0, at(0))]                                           # one micro-batch of another rank
    log = spark.createDataFrame(rows, "epoch int, rank int, batch_idx long, ts timestamp").repartition(3)
    got = {(r["rank"], r.epoch): r for r in TM.resumed_epoch_summary(log, 60, 2, 1, 10, 3).collect()}
    a, b, c = got[0, 0], got[0, 1], got[1, 0]
    assert (a.runs, a.active_seconds, a.pause_seconds, a.steps, a.repeated, a.total_tokens) == (2, 80.0, 950.0, 4, 2, 4 * 60)
    assert (b.runs, b.active_seconds, b.steps, b.total_tokens) == (1, 15.0, 2, 6 * 60) and b.avg_tokens_per_second == 360 / 95.0
    assert (c.runs, c.active_seconds, c.steps, c.total_tokens, c.avg_tokens_per_second) == (1, 0.0, 0, 0, 0.0)
    assert TM.resumed_epoch_summary(log.limit(0), 60, 2).count() == 0
