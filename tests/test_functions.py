import pytest
from pyspark.sql import functions as F

from tokenmill.functions.text import human_size, prompt_key, report_line, thousands
from tokenmill.functions.training import flops_per_token, mfu, wsd_lr
from tokenmill.operators import telemetry as TM


def test_human_size(spark):
    vals = [0, 512, 1023, 1024, 1536, 1048576]
    df = spark.createDataFrame([(v,) for v in vals], "b long")
    got = [r.s for r in df.select(human_size("b").alias("s")).collect()]
    assert got == ["0B", "512.0 B", "1023.0 B", "1.0 KB", "1.5 KB", "1.0 MB"]


def test_report_line_and_thousands(spark):
    df = spark.createDataFrame([("src", 1536, 12.345, 1234567)], "s string, b long, p double, n long")
    r = df.select(report_line("s", "b", "p").alias("l"), thousands("n").alias("t")).first()
    assert r.l == "  - src                 : 1.5 KB     (12.35%)"
    assert r.t == "1,234,567"


def test_wsd_schedule(spark):
    steps = [0, 9, 10, 19, 20, 25, 30, 99]
    df = spark.createDataFrame([(s,) for s in steps], "s long")
    lr = wsd_lr("s", peak_lr=1.0, min_lr=0.1, warmup_steps=10, decay_start_step=20, decay_steps=10)
    got = [round(r.lr, 6) for r in df.select(lr.alias("lr")).collect()]
    assert got == [0.1, 1.0, 1.0, 1.0, 1.0, 0.55, 0.1, 0.1]


def test_wsd_zero_decay_gives_min(spark):
    df = spark.createDataFrame([(30,)], "s long")
    lr = wsd_lr("s", peak_lr=1.0, min_lr=0.1, warmup_steps=10, decay_start_step=20, decay_steps=0)
    assert df.select(lr.alias("lr")).first().lr == 0.1


def test_mfu_rules(spark):
    df = spark.createDataFrame([(0.0,), (1.0,)], "t double")
    got = [r.m for r in df.select(mfu(F.lit(10), "t", F.lit(1e12), F.lit(1.0)).alias("m")).collect()]
    assert got == [0.0, 1.0]


def test_flops_fallback(spark):
    r = spark.range(1).select(flops_per_token(100, 2048, 1024, 1000, 2).alias("d"),
                              flops_per_token(100, 2048, None, 1000, 2).alias("f")).first()
    assert r.f == 600.0
    assert r.d == pytest.approx(600 * (1 + 2048 / (12 * 1024) + 1000 / (16 * 2 * 1024)))


def test_gpu_peak(spark):
    names = ["NVIDIA GeForce RTX 4090", "NVIDIA H800", None, "Tesla V100 with T4"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.p for r in df.select(TM.gpu_peak("n").alias("p")).collect()]
    assert got == [330e12, 100e12, 0.0, 125e12]


def test_macro_average(spark):
    df = spark.createDataFrame([("m", "a", 0.0), ("m", "b", 10.0), ("m", "c", 20.0)],
                               "method string, subject string, accuracy double")
    assert TM.macro_average(df).first().macro_avg == 10.0
    assert TM.macro_average(df, drop_zero=True).first().macro_avg == 15.0


def test_prompt_key(spark):
    df = spark.createDataFrame([("The capital of the United States is",)], "p string")
    assert df.select(prompt_key("p").alias("k")).first().k == "测试/输入_The capita"


def test_sizes_round_like_python(spark):
    # 1152 B = 1.125 KB, an exact tie: Python rounds half to even -> 1.12
    vals = [1152, 1664, int(1.015 * 1024 * 1024), 5 * 1024 ** 3 + 123456789]
    df = spark.createDataFrame([(v,) for v in vals], "b long")
    got = [r.s for r in df.select(human_size("b").alias("s")).collect()]

    def py(b):
        import math
        names = ("B", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")
        i = int(math.floor(math.log(b, 1024)))
        return f"{round(b / math.pow(1024, i), 2)} {names[i]}"

    assert got == [py(v) for v in vals]


def test_integer_division_is_exact(spark):
    from tokenmill.functions._cols import ceil_div, idiv
    vals = [0, 1, 7, 8, 9, -1, -9, 2 ** 62 + 12345, 2 ** 53 + 1]
    df = spark.createDataFrame([(v,) for v in vals], "c long")
    for r in df.select("c", idiv("c", 8).alias("d"), ceil_div("c", 8).alias("e")).collect():
        assert r.d == r.c // 8 and r.e == -((-r.c) // 8)


def test_lr_schedule_table(spark):
    from tokenmill import api as tm
    rows = tm.lr_schedule(spark, 40, peak_lr=1.0, min_lr=0.1, warmup_steps=10, decay_start_step=20,
                          decay_steps=10).collect()
    assert len(rows) == 40 and rows[0].step == 0
    assert [round(r.lr, 6) for r in rows if r.step in (0, 9, 25, 39)] == [0.1, 1.0, 0.55, 0.1]
