"""Colours, hashes, tokens and dates against plain Python."""

import colorsys
import datetime
import json
import random

from pyspark.sql import functions as F

from gridloom.functions import dates, tokens, units
from gridloom.operators import cells as C


def test_tints(spark):
    rng = random.Random(1)
    rows = [("%06X" % rng.randint(0, 0xFFFFFF), round(rng.uniform(-1, 1), 3)) for _ in range(300)] + [("808080", 0.5), ("000000", -0.5), ("FFFFFF", 1.0), ("FF0000", 0.0)]

    def plain(rgb, tint):
        h, light, s = colorsys.rgb_to_hls(*(int(rgb[i : i + 2], 16) / 255 for i in (0, 2, 4)))
        light = light * (1 + tint) if tint < 0 else light * (1 - tint) + tint
        return [x * 255 for x in colorsys.hls_to_rgb(h, min(1.0, max(0.0, light)), s)]

    for r in spark.createDataFrame(rows, "rgb string, tint double").select("*", units.tinted(F.col("rgb"), F.col("tint")).alias("out")).collect():
        got = [int(r["out"][i : i + 2], 16) for i in (0, 2, 4)]
        assert all(abs(a - b) <= 0.5 + 1e-6 for a, b in zip(got, plain(r["rgb"], r["tint"]), strict=True)), r


def test_password_hashes_of_any_length(spark):
    rng = random.Random(2)
    words = ["", "a", "test", "é日", "x" * 40, "y" * 41, "".join(chr(rng.randint(33, 0x3000)) for _ in range(90)), None]

    def plain(p):
        h = 0
        for i, c in enumerate(p, 1):
            v = ord(c) << i
            h ^= (v & 0x7FFF) | (v >> 15)
        return f"{h ^ len(p) ^ 0xCE4B:X}"

    got = spark.createDataFrame([(w,) for w in words], "p string").select("p", units.password_hash(F.col("p")).alias("h")).collect()
    assert {r["p"]: r["h"] for r in got} == {w: None if w is None else plain(w) for w in words}


def test_token_values(spark):
    epoch = lambda d: int((d - datetime.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    known = {
        "12": ("number", 12.0, None, None), "-1.5e3": ("number", -1500.0, None, None), "@float:nan": None, "TRUE": ("bool", 1.0, None, None), '"12"': ("text", None, "12", None), json.dumps('a"\n'): ("text", None, 'a"\n', None),
        "plain text": ("text", None, "plain text", None), "#N/A": ("error", None, "#N/A", None), '@err:"odd one"': ("error", None, "odd one", None), "2024-02-29": ("date", None, None, epoch(datetime.datetime(2024, 2, 29))),
        "2024-02-29 01:02:03.5": ("date", None, None, epoch(datetime.datetime(2024, 2, 29, 1, 2, 3, 500_000))), "01:02:03": ("date", None, None, 3_723_000_000), "@td:-26:00:01.000002": ("date", None, None, -93_601_000_002), "@date:1999-12-31": ("date", None, None, epoch(datetime.datetime(1999, 12, 31))),
    }
    got = {r["t"]: tuple(r["v"]) for r in spark.createDataFrame([(t,) for t in known], "t string").select("t", tokens.token_value(F.col("t")).alias("v")).collect()}
    nan = got.pop("@float:nan")
    assert nan[0] == "number" and nan[1] != nan[1] and got == {t: v for t, v in known.items() if v}


def test_numbers_as_written(spark):
    values = [0.1, 1e21, 1.0, 1 / 3, -2.5e-7, 123456789012345678.0, float("nan"), float("inf"), None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(tokens.number_text(F.col("v"))).collect()]
    assert got == ["0.1", "1e+21", "1", "0.3333333333333333", "-2.5e-07", "1.234567890123457e+17", "", "", None]


def test_civil_dates_and_iso(spark):
    days = [0, -1, 19_782, -719_162, 2_932_896]
    row = spark.createDataFrame([(d,) for d in days], "d bigint").select("d", dates.civil_from_days(F.col("d")).alias("c")).select("d", "c.*", dates.days_from_civil(F.col("c.year"), F.col("c.month"), F.col("c.day")).alias("back"))
    for r in row.collect():
        want = datetime.date(1970, 1, 1) + datetime.timedelta(days=r["d"])
        assert (r["year"], r["month"], r["day"], r["back"]) == (want.year, want.month, want.day, r["d"])
    moments = [datetime.datetime(2024, 1, 2, 3, 4, 5), datetime.datetime(2024, 1, 2, 3, 4, 5, 6_999), datetime.datetime(1900, 1, 1, 0, 0, 0, 1)]
    got = [r[0] for r in spark.createDataFrame([(m,) for m in moments], "t timestamp_ntz").select(dates.iso_text(F.col("t"))).collect()]
    assert got == [m.isoformat(timespec="milliseconds") if m.microsecond else m.isoformat() for m in moments]
    bad = spark.range(1).select(dates.days_from_civil(F.lit(2023), F.lit(2), F.lit(29)), dates.days_to_time(F.lit(1.75))).first()
    assert tuple(bad) == (None, 64_800_000_000)


def test_places_by_sort_columns(spark):
    rows = [("b", 2), ("a", 1), ("b", 1), (None, 3), ("a", 3)]
    got = C.numbered(spark.createDataFrame(rows, "k string, v int"), [F.desc_nulls_last("k"), "v"], "place").orderBy("place").collect()
    assert [tuple(r) for r in got] == [("b", 1, 1), ("b", 2, 2), ("a", 1, 3), ("a", 3, 4), (None, 3, 5)]
