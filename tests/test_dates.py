from __future__ import annotations

import random
import warnings
from datetime import datetime

from dateutil import parser

from pyspark.sql import functions as F

import presscan as ps

GOLDEN = {
    "2031-02-03T04:05:06-06:00": "2031-02-03T04:05:06-06:00",
    "2031-02-03": "2031-02-03T00:00:00",
    "2031-02-03T04:05:06Z": "2031-02-03T04:05:06+00:00",
    "2031-02-03T04:05:06-0600": "2031-02-03T04:05:06-06:00",
    "2031-02-03T04:05:06.5+01:00": "2031-02-03T04:05:06.500000+01:00",
    "2031-02-03 04:05": "2031-02-03T04:05:00",
    "Mon, 03 Feb 2031 04:05:06 GMT": "2031-02-03T04:05:06+00:00",
    "February 3, 2031 4:05 PM": "2031-02-03T16:05:00",
    "23/02/2031": "2031-02-23T00:00:00",
    "02/03/2031": "2031-02-03T00:00:00",
    "20310203": "2031-02-03T00:00:00",
    "2031-02-03T04:05:06 CST": "2031-02-03T04:05:06",
    "12:00 AM": None,
    "16 de junio de 2026": None,
    "June 2026": None,
    "not a date": None,
    "2031-02-30": None,
    "  ": None,
    "": None,
    None: None,
}


def test_golden_dates(evaluate):
    assert evaluate(ps.to_iso8601("v"), list(GOLDEN)) == list(GOLDEN.values())


FURTHER = {
    "2026-06-14 6pm": "2026-06-14T18:00:00",
    "14-Jun-26": "2026-06-14T00:00:00",
    "14 Jun 93": "1993-06-14T00:00:00",
    "2026 June 14": "2026-06-14T00:00:00",
    "2026/Jun/14 06:07": "2026-06-14T06:07:00",
    "Sun, 14 Jun 2026 18:14:00 -0600 (CST)": "2026-06-14T18:14:00-06:00",
    "2026-06-14T18:14:00.1234567890": "2026-06-14T18:14:00.123456",
    "Sun Jun 14 18:14:00 2026": "2026-06-14T18:14:00",
    "Sun Jun 14 18:14:00 UTC 2026": "2026-06-14T18:14:00+00:00",
    "10:00 2026-06-14": "2026-06-14T10:00:00",
    "6:30 p.m. on June 14, 2026": "2026-06-14T18:30:00",
    "06/14/26": "2026-06-14T00:00:00",
    "14.06.26": "2026-06-14T00:00:00",
    "2026 06 14": "2026-06-14T00:00:00",
    "14 Jun 2026 18:14 GMT+3": "2026-06-14T18:14:00-03:00",
    "14 Jun 2026 18:14 EST -0500": "2026-06-14T18:14:00-05:00",
}


def test_further_layouts(evaluate):
    assert evaluate(ps.to_iso8601("v"), list(FURTHER)) == list(FURTHER.values())
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert [complete(v) for v in FURTHER] == list(FURTHER.values())


def test_dates_stay_native(spark):
    pages = spark.createDataFrame([("u", "<title>x</title>")], "url string, html string")
    for rows in (spark.range(1).select(ps.to_iso8601(F.lit("x").alias("v"))), ps.page_metadata(pages)):
        assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()


def complete(text: str) -> str | None:
    """The public parser, with incomplete dates told apart by two defaults."""
    try:
        one, two = (parser.parse(text, default=datetime(*d)).isoformat() for d in ((2000, 1, 1), (2004, 3, 3)))
    except (ValueError, OverflowError):
        return None
    return one if one == two else None


def test_random_dates_agree_with_the_public_parser(evaluate):
    rng = random.Random(7)

    def some_date() -> str:
        year, month, day, sep = rng.randint(1000, 9999), rng.randint(1, 13), rng.randint(1, 32), rng.choice("-/.")
        name = rng.choice(["Jan", "February", "May", "Sept", "Dec."])
        date = rng.choice(
            [
                f"{year}{sep}{month:02}{sep}{day}",
                f"{month}{sep}{day:02}{sep}{year}",
                f"{day:02}{sep}{month:02}{sep}{year}",
                f"{year}{month:02}{day:02}",
                f"Tue, {day} {name} {year}",
                f"{name} {day}, {year}",
                f"{year} {name} {day}",
                f"{day}-{name}-{year % 100:02}",
                f"{month:02}{sep}{day}{sep}{year % 100:02}",
                f"{name}-{day:02}-{year}",
                f"Wed {day:02} {name} {year % 100:02}",
            ]
        )
        clock = rng.choice(["", f" {rng.randint(0, 24)}:{rng.randint(0, 60):02}", f"T{rng.randint(0, 23):02}:07:{rng.randint(0, 60):02}.25"])
        clock += rng.choice(["", " PM", "Z", " +0530", "-03:00", " EST", " GMT-4", " -0600 (CST)"]) if clock else ""
        if clock.startswith(" ") and rng.random() < 0.2:
            return f"{clock.strip()} {date}"
        return date + clock

    values = [some_date() for _ in range(6000)]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        expected = [complete(v) for v in values]
    got = evaluate(ps.to_iso8601("v"), values)
    assert [(v, g, e) for v, g, e in zip(values, got, expected) if g != e][:9] == []
