import pytest

from logtrawl.functions import times

STAMPS = {
    "2024-01-01 00:00:07.179575 | x": 1704067207179575,
    "2020-07-04 03:00:10 abc": 1593831610000000,
    "2020-07-04 03:00:10": 1593831610000000,
    "2020-07-04 03:00:10.5 abc": 1593831610500000,
    "2020-07-04 03:00:10.123456789 x": 1593831610123456,
    "2020-07-04 03:00": 1593831600000000,
    "2020-07-04 3": 1593831600000000,
    "2020-07-04": 1593820800000000,
    "2020-07-04T03:00:00.123456": 1593820800000000,
    "2000-02-29 00:00:00": 951782400000000,
    "2020-13-04 03:00:10": None,
    "2021-02-29 00:00:00": None,
    " 2020-07-04 03:00:10": None,
    "garbage": None,
    "": None,
}


@pytest.mark.parametrize("zone", ["UTC", "America/Chicago"])
def test_line_micros(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame([(s,) for s in STAMPS], "line string")
        got = {r.line: r.us for r in rows.selectExpr("line", f"{times.line_micros('line')} AS us").collect()}
        assert got == STAMPS
        shown = spark.range(1).selectExpr(
            f"{times.micros_to_stamp('1593831610500000L', True)} AS a", f"{times.micros_to_stamp('1600317601000000L')} AS b"
        ).first()
        assert (shown.a, shown.b) == ("2020-07-04 03:00:10.500000", "2020-09-17 04:40:01")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_durations(spark):
    row = spark.range(1).selectExpr(
        f"{times.duration_text('13001220L')} AS text", f"{times.duration_text('90061000001L')} AS days",
        f"{times.hms_micros_col(chr(39) + '01:02:03' + chr(39))} AS full", f"{times.hms_micros_col(chr(39) + '02' + chr(39))} AS hours",
    ).first()
    assert row.text == "0d 0h 0m 13s 1220us"
    assert row.days == "1d 1h 1m 1s 1us"
    assert (row.full, row.hours) == (3723000000, 7200000000)
    parts = times.duration_parts("(400 * 86400000000L + 5L)", ("year", "month", "day"))
    row = spark.range(1).selectExpr(*[f"{v} AS {k}" for k, v in parts.items()]).first()
    assert (row.year, row.month, row.day, row.micro) == (1, 1, 5, 5)
    with pytest.raises(ValueError):
        times.duration_parts("1L", ("week",))


def test_arguments():
    assert times.hms_micros("00:30:00") == 1800 * times.SECOND
    assert times.stamp_span("2020-07") == (1593561600000000, 31 * times.DAY)
    assert times.stamp_span("2020-07-04") == (1593820800000000, times.DAY)
    assert times.stamp_span("2020-07-04 03") == (1593831600000000, times.HOUR)
    assert times.stamp_span("2020-07-04 03:00:10.25") == (1593831610250000, 0)
    now = times.stamp_span("2020-07-31 00:00:00")[0]
    assert times.time_spec("4:days", now) == now - 4 * times.DAY
    assert times.time_spec("2:weeks", now) == now - 14 * times.DAY
    assert times.time_spec("1:month", now) == now - 30 * times.DAY
    assert times.time_spec("2020-05-04 17:30:00") == times.stamp_span("2020-05-04 17:30:00")[0]
    assert times.end_argument("01:00:00", now) == now + times.HOUR
    for wrong in ("soon", "x:days", "2020"):
        with pytest.raises(ValueError):
            times.time_spec(wrong, now)
